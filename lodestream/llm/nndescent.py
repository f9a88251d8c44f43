"""Operator 6: approximate nearest neighbours by inner product with NN-descent.

Equal vectors are one node.  A node's vector gets one more component, so that all would have
the length of the longest and the largest inner product be the nearest; the component is kept as what it lacks of that length,
and nodes are compared by distance, so that in float32 short vectors beside very long ones stay apart.  The graph
starts from brute force within the cells of TREES random sign projections; then each
node's neighbours and reverse neighbours (DEGREE of each, of the latter new ones first)
meet at the node, and every pair of them may become neighbours: the neighbours of a
neighbour are likely neighbours.  Rounds end when SETTLED of the edges or fewer are new.

A query searches greedily from its own node and the ENTRIES longest ones (whose products are large with whatever
points their way, and which short nodes have no links to) until all of its best `w` seen are expanded, w from START on;
then w is doubled, until a doubling leaves its k best as they were but for ALIKE of them,
however far that is.  In the search nodes and queries lie in parts: a hop joins what a
part of the queries wants expanded with the links of each part of the nodes, the nodes so
found with their vectors, and the inner products with the queries' pools, all as packed
arrays, whose number follows the parts and not the candidates.  Both ends follow the data, so that the same constants serve any number of vectors.  The
best SURE, and the LONGEST longest nodes, are scored again in double precision on the original vectors.  All lengths are taken
against the longest but those LONGEST, which count as of that length until then, so that a few of any length leave the others as they are.

Every vector is in the graph.  Queries go in parts of about PART or PART_BYTES, whose vectors each task
holds; besides, no task holds more than a cell of CELL vectors, a node's neighbours, a part
of the nodes with what looks at them in one hop, or a part of the queries with what they find.

Defined results: vectors that are null, zero, or hold null or non-finite components take
no part, nor do null ids; shorter vectors count as filled up with zeros; of several vectors
of one id the least takes part; a node of more members than k gives its smallest ids."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.llm.common import Stored, require

DEGREE, TREES, CELL, SETTLED = 32, 5, 400, 0.04
START, AHEAD, SURE, SALTS, PART, PART_BYTES, LONGEST, ENTRIES = 100, 64, 60, 64, 100_000, 64 << 20, 64, 16
#: Nodes of a part, and queries of a part.
NODES, QUERIES = 4096, 256
#: A query ends when doubling its width changes this share of its k best or less.
ALIKE = 0.05


def _whole_groups(batches, key: int = 0) -> Iterator[pa.Table]:
    """Sorted batches as tables that never break a group of equal keys."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy()
        new = np.flatnonzero(k[1:] != k[:-1])
        if held and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if len(new):
            at = int(new[-1]) + 1
            yield pa.Table.from_batches([*held, b.slice(0, at)]).combine_chunks()
            held = [b.slice(at)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _matrix(col, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(-1, dim)


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Minus half the squared distance of each row of x to each of y."""
    return x @ y.T - (x * x).sum(1)[:, None] / 2 - (y * y).sum(1)[None, :] / 2


def _bounds(k: np.ndarray) -> np.ndarray:
    return np.r_[0, np.flatnonzero(k[1:] != k[:-1]) + 1, len(k)]


#: Lengths are held in this unit, so that none is beyond a double's range.
UNIT = 2.0**20


def _embed(dim: int, longest: float, planes: np.ndarray):
    """longest: the length, in UNITs, that none counts beyond."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            most = np.abs(x).max(1)
            x = x / most[:, None]
            own = np.sqrt((x * x).sum(1))
            size = np.minimum(1, most / UNIT * own / longest)
            x = x / own[:, None] * size[:, None]
            v = np.column_stack([x, size**2 / (1 + np.sqrt(1 - size**2))]).astype(np.float32)
            cells = [((x @ p.T > 0) @ (1 << np.arange(len(p), dtype=np.int64))).astype(np.int64) for p in planes]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in v], pa.binary()), pa.array(np.column_stack(cells).tolist(), pa.list_(pa.int64()))], names=["id", "vec", "cells"])

    return run


def _cell(dim: int, k: int):
    """The k nearest of each vector within its cell."""

    def run(table: pa.Table) -> pa.Table:
        ids, x = table["id"].to_numpy(), _matrix(table["vec"], dim)
        us, vs, ss = [], [], []
        for lo in range(0, len(ids), 512):
            g = _near(x[lo : lo + 512], x)
            g[np.arange(len(g)), lo + np.arange(len(g))] = -np.inf
            n = min(k, len(ids) - 1)
            if n < 1:
                break
            top = np.argpartition(-g, n - 1, axis=1)[:, :n]
            us.append(np.repeat(ids[lo : lo + 512], n))
            vs.append(ids[top].ravel())
            ss.append(np.take_along_axis(g, top, 1).ravel())
        cat = lambda a, t: np.concatenate(a).astype(t) if a else np.zeros(0, t)
        return pa.table({"u": cat(us, np.int64), "v": cat(vs, np.int64), "s": cat(ss, np.float32)})

    return run


def _local_join(dim: int, emit: int):
    """Members of a node meet: for each the best `emit` others above what it has."""

    def run(batches):
        for t in _whole_groups(batches):
            at = _bounds(t["center"].to_numpy())
            ids, least, fresh, x = t["member"].to_numpy(), t["least"].to_numpy(), t["fresh"].to_numpy(zero_copy_only=False), _matrix(t["vec"], dim)
            us, vs, ss = [], [], []
            for a, e in zip(at[:-1], at[1:], strict=True):
                if e - a < 2 or not fresh[a:e].any():
                    continue
                g = _near(x[a:e], x[a:e])
                f = fresh[a:e]
                g[~(f[:, None] | f[None, :])] = -np.inf  # these have met before
                np.fill_diagonal(g, -np.inf)
                n = min(emit, e - a - 1)
                top = np.argpartition(-g, n - 1, axis=1)[:, :n]
                s = np.take_along_axis(g, top, 1)
                i, j = np.nonzero(s > least[a:e, None])
                us.append(ids[a + i])
                vs.append(ids[a + top[i, j]])
                ss.append(s[i, j])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs)), pa.array(np.concatenate(ss))], names=["u", "v", "s"])

    return run


def _cat(col, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in col.to_pylist() if x is not None), kind)


def _raw(arrays) -> pa.Array:
    return pa.array([np.ascontiguousarray(a).tobytes() for a in arrays], pa.binary())


_BLOCK = "part int, id binary, n binary, x binary"
_PAIRS = "part int, v binary, q binary, s binary"
_STATE = "qpart int, part int, v binary, q binary, s binary, state binary, top binary, w binary"


def _vec_block(table: pa.Table) -> pa.Table:
    """The vectors of one part of the nodes, by id."""
    t = table.sort_by("id")
    return pa.table({"part": pa.array([t["part"][0].as_py()], pa.int32()), "id": _raw([t["id"].to_numpy()]), "n": pa.nulls(1, pa.binary()), "x": pa.array([b"".join(t["vec"].to_pylist())], pa.binary())})


def _link_block(table: pa.Table) -> pa.Table:
    """The links of one part of the nodes, by id."""
    t = table.sort_by("id").combine_chunks()
    vs = t["vs"].combine_chunks()
    return pa.table({"part": pa.array([t["part"][0].as_py()], pa.int32()), "id": _raw([t["id"].to_numpy()]), "n": _raw([vs.value_lengths().to_numpy()]), "x": _raw([vs.flatten().to_numpy()])})


def _split(part: np.ndarray, *cols: np.ndarray) -> tuple[list[int], list[list[np.ndarray]]]:
    """Columns cut up by part."""
    o = np.argsort(part, kind="stable")
    at = _bounds(part[o]) if len(o) else np.zeros(1, np.int64)
    return part[o][at[:-1]].tolist(), [[c[o[i:j]] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)] for c in cols]


def _once(v: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of node and query once."""
    o = np.lexsort((q, v))
    v, q = v[o], q[o]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (q[1:] != q[:-1])
    return v[new], q[new]


def _pairs(name: str, part: np.ndarray, v: np.ndarray, q: np.ndarray, s: np.ndarray | None = None) -> pa.Table:
    parts, (vs, qs, *ss) = _split(part, v, q, *([] if s is None else [s]))
    return pa.table({name: pa.array(parts, pa.int32()), "v": _raw(vs), "q": _raw(qs), "s": _raw(ss[0]) if ss else pa.nulls(len(parts), pa.binary())})


def _spread(parts: int):
    """A part's nodes that queries want expanded, and its links: what these queries look at next."""

    def run(asks: pa.Table, block: pa.Table) -> pa.Table:
        u, q = _cat(asks["v"], np.int64), _cat(asks["q"], np.int32)
        if not len(u) or not block.num_rows:
            return _pairs("part", *[np.zeros(0, np.int64)] * 3)
        ids, n, links = _cat(block["id"], np.int64), _cat(block["n"], np.int32).astype(np.int64), _cat(block["x"], np.int64)
        at = np.searchsorted(ids, u)
        ok = ids[np.minimum(at, len(ids) - 1)] == u  # a node without links asks for nothing
        at, q = at[ok], q[ok]
        m = n[at]
        first = np.repeat((np.cumsum(n) - n)[at] - (np.cumsum(m) - m), m)
        v, q = _once(links[first + np.arange(len(first))], np.repeat(q, m))
        return _pairs("part", v % parts, v, q)

    return run


def _score(dim: int, x: np.ndarray):
    """A part's nodes that queries look at, and its vectors: inner products. x: the queries' vectors."""

    def run(pairs: pa.Table, block: pa.Table) -> pa.Table:
        v, q = _cat(pairs["v"], np.int64), _cat(pairs["q"], np.int32)
        if not len(v):
            return _pairs("qpart", *[np.zeros(0, np.int64)] * 3)
        v, q = _once(v, q)
        ids, vec = _cat(block["id"], np.int64), _cat(block["x"], np.float32).reshape(-1, dim)
        at = np.searchsorted(ids, v)
        s = np.empty(len(v), np.float32)
        for lo in range(0, len(v), 1 << 15):
            cut = slice(lo, lo + (1 << 15))
            s[cut] = np.einsum("ij,ij->i", x[q[cut]], vec[at[cut]])
        return _pairs("qpart", q // QUERIES, v, q, s)

    return run


def _state(qpart: int, parts: int, v, q, s, state, top, w) -> pa.Table:
    """One row with the pools of a part of the queries, and one for each part of the nodes that they want expanded."""
    now = state == 2
    ask, (us, qs) = _split(v[now] % parts, v[now], q[now])
    none = [None] * len(ask)
    cols = {"qpart": [qpart, *none], "part": [None, *ask], "v": [v, *us], "q": [q, *qs], "s": [s, *none], "state": [state, *none], "top": [top, *none], "w": [w, *none]}
    kinds = {"qpart": pa.int32(), "part": pa.int32()}
    return pa.table({c: pa.array(x, kinds[c]) if c in kinds else pa.array([None if y is None else np.ascontiguousarray(y).tobytes() for y in x], pa.binary()) for c, x in cols.items()})


def _advance(k: int, parts: int):
    """The pools of a part of the queries with what was found: duplicates go, and what is to be expanded next is marked.
    state of a node: 0 seen, 1 expanded, 2 to be expanded now; w (one a query) is 0 when the query has ended."""
    sure = max(SURE, 2 * k)

    def one(v, s, state, top, w):
        o = np.lexsort((-state.astype(np.int8), v))  # of a node's rows the one in the pool, if it is expanded, comes first
        new = np.r_[True, v[o[1:]] != v[o[:-1]]]
        first, at = o[new], np.flatnonzero(new)
        top = np.maximum.reduceat(top[o], at)
        v, s, state = v[first], s[first], np.minimum(state[first], 1)
        o = np.lexsort((v, -s))
        v, s, state, top = v[o], s[o], state[o], top[o]
        while w:
            open_ = np.flatnonzero(state[:w] == 0)
            if len(open_):
                state[open_[: max(AHEAD, w // 4)]] = 2
                break
            if int((top[: k + 1] == 0).sum()) <= ALIKE * k or len(v) <= w:
                w = 0
            else:
                top = (np.arange(len(v)) <= k).astype(np.uint8)
                w *= 2
        n = max(2 * w, sure)
        return v[:n], s[:n], state[:n], top[:n], w

    def run(pool: pa.Table, found: pa.Table) -> pa.Table:
        qpart = pool["qpart"][0].as_py()
        v, q, s = (np.concatenate([_cat(pool[c], t), _cat(found[c], t)]) for c, t in (("v", np.int64), ("q", np.int32), ("s", np.float32)))
        more = np.zeros(len(v) - len(pool["state"][0].as_py()), np.uint8)
        state, top = (np.r_[_cat(pool[c], np.uint8), more] for c in ("state", "top"))
        w = _cat(pool["w"], np.int32).copy()
        o = np.argsort(q, kind="stable")
        at = np.searchsorted(q[o], qpart * QUERIES + np.arange(len(w) + 1))
        got = []
        for i, (a, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            x = o[a:e]
            if w[i]:
                *cols, w[i] = one(v[x], s[x], state[x], top[x], int(w[i]))
                got.append(cols)
            else:
                got.append([v[x], s[x], state[x], top[x]])
        q = np.repeat(qpart * QUERIES + np.arange(len(w), dtype=np.int32), [len(g[0]) for g in got]).astype(np.int32)
        v, s, state, top = (np.concatenate([g[i] for g in got]) for i in range(4))
        return _state(qpart, parts, v, q, s, state, top, w)

    return run


def _best(asked: np.ndarray):
    """The pools' nodes as rows."""

    def run(batches):
        for b in batches:
            q, v, s = _cat(b.column("q"), np.int32), _cat(b.column("v"), np.int64), _cat(b.column("s"), np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(v), pa.array(s)], names=["q", "v", "s"])

    return run


def _prime(least: int) -> int:
    n = max(1, least)
    while any(n % d == 0 for d in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def _top(df: DataFrame, by: str, order: list, n: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rn") <= n).drop("rn")


class Index:
    """The graph over all nodes, as tables: nodes (id, vec), edges (u, v, s), links (u, v) both ways."""

    def __init__(self, vectors: DataFrame, degree: int = DEGREE, settled: float = SETTLED, seed: int = 11):
        require(vectors, "vec_id", "embedding")
        spark = vectors.sparkSession
        e = F.col("embedding")
        fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
        kind = "array<float>" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "array<double>"
        ok = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast(kind).alias("embedding")).where(F.col("vec_id").isNotNull() & fine)
        least, most = ok.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
        self.dim = most or 1
        if least != most:
            zeros = F.array_repeat(F.lit(0).cast(kind[6:-1]), F.lit(self.dim) - F.size("embedding"))
            ok = ok.withColumn("embedding", F.concat("embedding", zeros))
        one = ok.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        self.members = Stored(one, "ann-members")
        self.reps = Stored(self.members.df.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).select("id", "embedding", "n"), "ann-nodes")
        n = self.reps.df.count()
        most = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
        own = F.aggregate(F.transform("embedding", lambda x: x.cast("double") / F.col("most")), F.lit(0.0), lambda a, x: a + x * x)
        ends = self.reps.df.withColumn("most", most).select("id", (F.col("most") / UNIT * F.sqrt(own)).alias("size")).orderBy(F.desc("size"), "id").limit(LONGEST + 1).collect()
        self.ends, longest = [r.id for r in ends[:LONGEST]], ends[-1]["size"] if ends else 1.0
        rng = np.random.default_rng(seed)
        depth = max(1, math.ceil(math.log2(max(2, n) / (CELL / 3))))
        planes = rng.normal(size=(TREES, depth, self.dim))
        d = self.d = self.dim + 1
        self.nodes = Stored(self.reps.df.select("id", "embedding").mapInArrow(_embed(self.dim, longest or 1.0, planes), "id long, vec binary, cells array<long>"), "ann-vec")
        vec = self.nodes.df.select("id", "vec")
        cells = self.nodes.df.select("id", "vec", F.posexplode("cells").alias("tree", "cell"))
        size = cells.groupBy("tree", "cell").agg(F.ceil(F.count("*") / CELL).alias("parts"))
        cells = cells.join(size, ["tree", "cell"]).withColumn("part", F.pmod(F.xxhash64("id", "tree"), F.col("parts")))
        found = cells.select("tree", "cell", "part", "id", "vec").groupBy("tree", "cell", "part").applyInArrow(_cell(d, degree), "u long, v long, s float")
        best = lambda x: _top(x, "u", [F.desc("s"), "v"], degree)
        edges = Stored(best(found.groupBy("u", "v").agg(F.max("s").alias("s"))).withColumn("fresh", F.lit(True)), "ann-edges")
        self.rounds, fresh = 0, 1.0
        while fresh > settled:
            e = edges.df
            back = _top(e.select(F.col("v").alias("center"), F.col("u").alias("member"), "fresh").withColumn("o", F.xxhash64("center", "member")), "center", [F.desc("fresh"), "o"], degree).drop("o")
            meet = e.select(F.col("u").alias("center"), F.col("v").alias("member"), "fresh").union(back).groupBy("center", "member").agg(F.max("fresh").alias("fresh"))
            least = e.groupBy("u").agg(F.min("s").alias("m"), F.count("*").alias("c")).select(F.col("u").alias("member"), F.when(F.col("c") >= degree, F.col("m")).otherwise(F.lit(-9.0)).cast("float").alias("least"))
            rows = meet.join(vec.withColumnRenamed("id", "member").join(least, "member"), "member").select("center", "member", "least", "fresh", "vec")
            got = rows.repartition("center").sortWithinPartitions("center").mapInArrow(_local_join(d, max(4, degree // 4)), "u long, v long, s float")
            both = e.select("u", "v", "s", F.lit(False).alias("fresh")).unionByName(got.withColumn("fresh", F.lit(True)))
            merged = both.groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
            nxt = Stored(best(merged), "ann-edges")
            edges.drop()
            edges, self.rounds = nxt, self.rounds + 1
            fresh = nxt.df.agg(F.avg(F.col("fresh").cast("int"))).first()[0] or 0.0
        self.edges = edges
        e = edges.df
        back = _top(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "s"), "u", [F.desc("s"), "v"], degree)
        links = e.select("u", "v").union(back.select("u", "v")).groupBy(F.col("u").alias("id")).agg(F.collect_set("v").alias("vs"))
        # for the search, nodes lie in parts of about NODES by their id
        self.parts = _prime(math.ceil(max(1, n) / NODES))
        part = F.pmod("id", F.lit(self.parts)).cast("int").alias("part")
        self.vecs = Stored(vec.select(part, "id", "vec").groupBy("part").applyInArrow(_vec_block, _BLOCK), "ann-vecs")
        self.links = Stored(links.select(part, "id", "vs").groupBy("part").applyInArrow(_link_block, _BLOCK), "ann-links")
        self.spark = spark

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """queries: q (a node's id). The nodes found best for each: q, v; SURE or 2 * k of them."""
        own = queries.join(self.nodes.df.select(F.col("id").alias("q"), "vec"), "q")
        parts = max(1, math.ceil(queries.count() / max(1, min(PART, PART_BYTES // (4 * self.d)))))
        found = None
        for i in range(parts):
            part = self._search(own.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == i), k)
            found = part if found is None else found.unionByName(part)
        return found

    def _search(self, own: DataFrame, k: int) -> DataFrame:
        held = own.toArrow().sort_by("q")
        asked = held["q"].to_numpy()
        x = _matrix(held["vec"], self.d).copy()
        parts, n = self.parts, len(asked)
        if not n:
            return self.spark.createDataFrame([], "q long, v long")
        x[:, -1] = 0
        ends = self.nodes.df.where(F.col("id").isin(self.ends[:ENTRIES])).select("id", "vec").toArrow().sort_by("id")  # ENTRIES rows
        own_s, end_s = (x * x).sum(1, dtype=np.float64), x.astype(np.float64) @ _matrix(ends["vec"], self.d).T
        long = np.sqrt(np.maximum(own_s, np.finfo(np.float64).tiny))
        x, own_s, end_s = (x / long[:, None]).astype(np.float32), long.astype(np.float32), (end_s / long[:, None]).astype(np.float32)
        end_v = ends["id"].to_numpy()
        cuts = [slice(lo, min(lo + QUERIES, n)) for lo in range(0, n, QUERIES)]

        def begin(i: int, c: slice) -> pa.Table:
            q = np.arange(c.start, c.stop, dtype=np.int32)
            v, s = np.column_stack([asked[c], np.broadcast_to(end_v, (len(q), len(end_v)))]), np.column_stack([own_s[c], end_s[c]])
            new = np.column_stack([np.ones(len(q), bool), end_v[None, :] != asked[c][:, None]])  # a node once
            m = int(new.sum())
            return _state(i, parts, v[new], np.repeat(q, new.sum(1)), s[new], np.full(m, 2, np.uint8), np.zeros(m, np.uint8), np.full(len(q), START, np.int32))

        start = pa.concat_tables([begin(i, c) for i, c in enumerate(cuts)])
        pool = Stored(self.spark.createDataFrame(start, _STATE), "ann-pool")
        self.hops = 0
        while not (now := pool.df.where("part is not null").select("part", "v", "q")).isEmpty():
            cand = now.groupBy("part").cogroup(self.links.df.groupBy("part")).applyInArrow(_spread(parts), _PAIRS)
            new = cand.select("part", "v", "q").groupBy("part").cogroup(self.vecs.df.groupBy("part")).applyInArrow(_score(self.d, x), _PAIRS.replace("part", "qpart"))
            nxt = Stored(pool.df.where("qpart is not null").groupBy("qpart").cogroup(new.groupBy("qpart")).applyInArrow(_advance(k, parts), _STATE), "ann-pool")
            pool.drop()
            pool, self.hops = nxt, self.hops + 1
        best = pool.df.select("q", "v", "s").mapInArrow(_best(asked), "q long, v long, s float")
        return _top(best, "q", [F.desc("s"), "v"], max(SURE, 2 * k)).select("q", "v")

    def drop(self) -> None:
        for s in (self.nodes, self.edges, self.vecs, self.links):
            s.drop()


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row that is_query holds for."""
    index = Index(vectors)
    members, reps = index.members.df, index.reps.df
    node = reps.select(F.col("id").alias("node"), "embedding")
    asked = Stored(members.where(is_query).join(node, "embedding").select(F.col("vec_id").alias("query_id"), "node", F.col("embedding").alias("qe")), "ann-asked")
    nodes = asked.df.select(F.col("node").alias("q")).distinct()
    always = nodes.select("q", F.explode(F.array(*map(F.lit, index.ends)).cast("array<bigint>")).alias("v"))
    found = Stored(index.search(nodes, k).unionByName(always).distinct(), "ann-found")
    index.drop()
    # the k + 1 smallest ids of a node are all that can be needed; first within salted parts
    many = members.join(reps.where("n > 1").select(F.col("id").alias("node"), "embedding"), "embedding").select("node", "vec_id")
    part = Window.partitionBy("node", "salt").orderBy("vec_id")
    many = many.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).withColumn("rn", F.row_number().over(part)).where(F.col("rn") <= k + 1).drop("rn", "salt")
    ids = _top(many, "node", ["vec_id"], k + 1).select(F.col("node").alias("v"), "vec_id").union(reps.where("n = 1").select(F.col("id").alias("v"), F.col("id").alias("vec_id")))
    dot = F.aggregate(F.zip_with("qe", "ve", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    near = found.df.join(reps.select(F.col("id").alias("v"), F.col("embedding").alias("ve")), "v")
    # by node of the query: exact scores once, then its k + 1 best with all members that count
    pairs = near.join(reps.select(F.col("id").alias("q"), F.col("embedding").alias("qe")), "q").select("q", "v", dot.alias("score"))
    best = _top(pairs.join(ids, "v"), "q", [F.desc("score"), "vec_id"], k + 1).select(F.col("q").alias("node"), "vec_id", "score")
    out = asked.df.select("query_id", "node").join(best, "node").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
