"""Operator 3: near-duplicate documents by HyperMinHash.

A document is its set of distinct k-word shingles.  Each shingle hash picks one of
REGISTERS buckets; a bucket keeps its least hash compressed to a leading-zero count (6
bits) and MANTISSA bits after the leading one.  Empty buckets borrow from a pseudo-
random full one, alike in every document.  BANDS bands of ROWS registers give
candidates: two sets of similarity 0.8 share no band with probability (1 - 0.8^5)^51,
below 2e-9, where the registers are independent.  Those that small sets borrow aren't, so
a pair whose smaller set has SMALL shingles or fewer is found exactly: the rarest shingles
of each such set, so many that linked sets must share one, are keys beside the bands.
A candidate's similarity is estimated from all registers, corrected for chance
collisions; of larger sets only what lies six standard errors below the threshold is let
go, and the rest is decided on the full shingle sets.

Documents with equal sets are one class, named by a hash of the set, and are compared
once.  Links needn't all be found to know the components, so a band's members are first
compared with a hub, then with another; pairs already in one component need no further
look.  Members of bands that are still apart after HUB_ROUNDS are compared in blocks
of BLOCK by BLOCK within a task, where only links that join components come out: those
of bands that touch each other together, so that a pair in several bands is seen once,
or band by band where these would be over TOGETHER blocks.  No group of copies is
expanded into its pairs.

Sets are of 64-bit hashes, and links are decided on full sets.

Defined results: a text without words (null, empty, blank) has an empty set, is linked
with nothing and kept; a text of fewer than k words is one shingle; a very long text is
read whole (memory follows the longest one); rows without doc_id are kept, with no
component; unlike texts under one doc_id are told apart by their sets, so each is linked
by its own; links depend on no order, so ties and repeated rows change nothing; other
columns, whatever their names, aren't looked at, and drop_near_duplicates() keeps them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestream.llm import textkernel as tk
from lodestream.llm.common import Stored, require
from lodestream.llm.graph import components

REGISTERS, ROWS, BANDS, MANTISSA, HUB_ROUNDS = 256, 5, 51, 10, 2
#: Shingles of the smaller set up to which candidates are exact.
SMALL = 32
#: Members of a block when what the hubs left apart is compared.
BLOCK = 512
#: Blocks of a group of touching bands, at most, that are compared together.
TOGETHER = 8
_SHORT = tk.mix(np.arange(64, dtype=np.uint64) + tk.U(0xABCDEF))


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, ascending, one text after the other; their offsets."""
    n = len(off) - 1
    h, doc = tk.words(buf, off)
    g, whole = tk.grams(h, doc, k)
    x, d = [g[whole]], [doc[: len(g)][whole]]
    c = tk.counts(doc, n)
    at = np.cumsum(c) - c
    for m in range(1, k):
        few = np.flatnonzero(c == m)
        if len(few):
            x.append(tk.mix(tk.grams(h, doc, m)[0][at[few]] + _SHORT[m % 64]))
            d.append(few)
    x, d = np.concatenate(x), np.concatenate(d)
    order = np.lexsort((x, d))
    x, d = x[order], d[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
    x, d = x[new], d[new]
    return x, np.r_[0, np.cumsum(tk.counts(d, n))]


def _borrow() -> np.ndarray:
    tries = np.arange(16 * REGISTERS, dtype=np.uint64).reshape(16, REGISTERS)
    return (tk.mix(tries + tk.U(0x5EED)) % tk.U(REGISTERS)).astype(np.int64)


_BORROW = _borrow()
_CYCLE = np.argsort(tk.mix(np.arange(REGISTERS, dtype=np.uint64) + tk.U(99)))


def registers(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Compressed registers (uint16) of each set; of an empty set all are zero."""
    n = len(at) - 1
    least = np.full(n * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    if len(x):
        cell = np.repeat(np.arange(n), np.diff(at)) * REGISTERS + (x % tk.U(REGISTERS)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        c = cell[order]
        first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        least[c[first]] = np.minimum.reduceat(x[order] >> tk.U(11), first)
    least = least.reshape(n, REGISTERS)
    full = least != np.iinfo(np.uint64).max
    lz = 53 - np.frexp(np.where(full, least, 0).astype(np.float64))[1]
    lz = np.where(full & (least > 0), lz, 53).astype(np.uint64)
    top = (least << lz) & tk.U((1 << 53) - 1)
    reg = ((lz << tk.U(MANTISSA)) | ((top >> tk.U(52 - MANTISSA)) & tk.U((1 << MANTISSA) - 1))).astype(np.uint16)
    out, have = reg.copy(), full.copy()
    some = full.any(1)
    for t in range(len(_BORROW)):
        rows = np.flatnonzero(some & ~have.all(1))
        if not len(rows):
            break
        b = _BORROW[t]
        take = ~have[rows] & full[rows][:, b]
        o = out[rows]
        o[take] = reg[rows][:, b][take]
        out[rows] = o
        h = have[rows]
        h[take] = True
        have[rows] = h
    for r in np.flatnonzero(some & ~have.all(1)):  # few shingles: on along a fixed cycle to a full bucket
        pos = np.flatnonzero(full[r][_CYCLE])
        nxt = pos[np.searchsorted(pos, np.arange(REGISTERS)) % len(pos)]
        src = np.empty(REGISTERS, np.int64)
        src[_CYCLE] = _CYCLE[nxt]
        out[r] = np.where(have[r], out[r], reg[r][src])
    out[~some] = 0
    return out


def _class_ids(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number for each set: of two sums over it and its size."""
    sa, sb = np.r_[tk.U(0), np.cumsum(tk.mix(x + tk.U(1)))], np.r_[tk.U(0), np.cumsum(tk.mix(x ^ tk.U(0x9E3779B97F4A7C15)))]
    n = np.diff(at).astype(np.uint64)
    return tk.mix(tk.mix(sa[at[1:]] - sa[at[:-1]] + n) ^ (sb[at[1:]] - sb[at[:-1]])).view(np.int64)


def _signatures(k: int, few: int):
    def run(batches):
        for b in batches:
            for i, j, buf, off in tk.text_blocks(b.column(1)):
                x, at = shingle_sets(buf, off, k)
                reg = registers(x, at)
                n = np.diff(at)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(_class_ids(x, at)), pa.array([r.tobytes() for r in reg], pa.binary()), pa.array([x[at[r] : at[r + 1]].view(np.int64) if n[r] <= few else None for r in range(j - i)], pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "cls", "regs", "few"])

    return run


def _sets(k: int):
    def run(batches):
        for b in batches:
            for i, j, buf, off in tk.text_blocks(b.column(1)):
                x, at = shingle_sets(buf, off, k)
                yield pa.RecordBatch.from_arrays([pa.array(_class_ids(x, at)), pa.array([x[at[r] : at[r + 1]].tobytes() for r in range(j - i)], pa.binary())], names=["id", "x"])

    return run


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> float:
    """Jaccard similarity from two register arrays, without the collisions expected by chance."""
    ratio = 4 * (n / m) / (1 + n / m) ** 2
    chance = REGISTERS * 0.1699 * ratio / (1 << MANTISSA)
    return (int((a == b).sum()) - chance) / (REGISTERS - chance)


def _likely(percent: int):
    """Of pairs with both register arrays, those that may reach the threshold."""

    def run(batches):
        for b in batches:
            n, m = b.column("n").to_numpy(), b.column("m").to_numpy()
            keep = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            idx = np.flatnonzero(keep)
            ra, rb = b.column("ra").to_pylist(), b.column("rb").to_pylist()
            for i in idx:
                est = estimate(np.frombuffer(ra[i], np.uint16), np.frombuffer(rb[i], np.uint16), int(n[i]), int(m[i]))
                used = REGISTERS * (1 - np.exp(-min(n[i], m[i]) / REGISTERS))
                p = percent / 100
                keep[i] = min(n[i], m[i]) <= SMALL or est >= p - 6 * np.sqrt(p * (1 - p) / used) - 0.02
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return run


def _linked(percent: int):
    """Of pairs with both full sets, those that are linked."""

    def run(batches):
        for b in batches:
            xa, xb = b.column("xa").to_pylist(), b.column("xb").to_pylist()
            ok = [_similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(xa, xb, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _block_links(percent: int):
    """Two blocks of one group (or one with itself): links between what is in different components.
    The likeliest pairs come first; a pair that earlier ones have joined needs no look."""

    def run(table: pa.Table) -> pa.Table:
        own, i, j = table["own"].to_numpy(), table["i"][0].as_py(), table["j"][0].as_py()
        rep, c, n = table["rep"].to_numpy(), table["c"].to_numpy(), table["n_shingles"].to_numpy()
        reg = np.frombuffer(b"".join(table["regs"].to_pylist()), np.uint16).reshape(len(rep), REGISTERS)
        sets = [np.frombuffer(x, np.uint64) for x in table["x"].to_pylist()]
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        p = percent / 100
        found = []
        for a in left:
            b = right[right > a] if i == j else right
            b = b[(c[b] != c[a]) & (100 * np.minimum(n[b], n[a]) >= percent * np.maximum(n[b], n[a]))]
            if len(b):
                same = (reg[b] == reg[a]).sum(1)
                ratio = n[b] / n[a]
                chance = REGISTERS * 0.1699 * 4 * ratio / (1 + ratio) ** 2 / (1 << MANTISSA)
                est = (same - chance) / (REGISTERS - chance)
                used = REGISTERS * (1 - np.exp(-np.minimum(n[b], n[a]) / REGISTERS))
                ok = (np.minimum(n[b], n[a]) <= SMALL) | (est >= p - 6 * np.sqrt(p * (1 - p) / used) - 0.02)
                found += [(-e, a, x) for e, x in zip(est[ok].tolist(), b[ok].tolist(), strict=True)]
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        out = []
        for _, a, b in sorted(found):
            ra, rb = root(int(c[a])), root(int(c[b]))
            if ra != rb and _similar(sets[a], sets[b], percent):
                up[max(ra, rb)] = min(ra, rb)
                out.append((int(rep[a]), int(rep[b])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _similar(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    z = np.sort(np.concatenate([u, v]), kind="stable")
    both = int((z[1:] == z[:-1]).sum())
    return 100 * both >= percent * (len(u) + len(v) - both)


def _verify(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    ra = reps.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n"), F.col("regs").alias("ra"))
    rb = reps.select(F.col("rep").alias("b"), F.col("n_shingles").alias("m"), F.col("regs").alias("rb"))
    likely = pairs.join(ra, "a").join(rb, "b").select("a", "b", "n", "m", "ra", "rb").mapInArrow(_likely(percent), "a long, b long")
    full = likely.join(sets.select(F.col("id").alias("a"), F.col("x").alias("xa")), "a").join(sets.select(F.col("id").alias("b"), F.col("x").alias("xb")), "b")
    return full.select("a", "b", "xa", "xb").mapInArrow(_linked(percent), "a long, b long")


def _prefixes(reps: DataFrame, percent: int) -> DataFrame:
    """rep, key: the rarest shingles of each set of few; without them too little is left for a link."""
    x = reps.where("few is not null").select("rep", "n_shingles", F.explode("few").alias("x"))
    rare = F.row_number().over(Window.partitionBy("rep").orderBy("n", "x"))
    ranked = x.join(x.groupBy("x").agg(F.count("*").alias("n")).where("n > 1"), "x", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("i", rare)
    return ranked.where(F.expr(f"i <= n_shingles - (n_shingles * {percent} + 99) div 100 + 1")).select("rep", F.xxhash64(F.lit(BANDS), "x").alias("key"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; linked: 100 * intersection >= percent * union."""
    return _near_duplicates(docs, k, percent).drop("cls")


def _near_duplicates(docs: DataFrame, k: int, percent: int) -> DataFrame:
    require(docs, "doc_id", "text")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = Stored(d.mapInArrow(_signatures(k, 100 * SMALL // percent), "doc_id long, n_shingles long, cls long, regs binary, few array<long>"), "sig")
    known = sig.df.where("n_shingles > 0 and doc_id is not null")
    classes = known.groupBy(F.col("cls").alias("rep"))
    reps = Stored(classes.agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"), F.first("few").alias("few")), "reps")
    band = F.posexplode(F.array(*[F.xxhash64(F.lit(i), F.substring("regs", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS)]))
    bands = reps.df.select("rep", band.alias("i", "key")).drop("i").unionByName(_prefixes(reps.df, percent))
    shared = bands.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("key")
    live = Stored(bands.join(shared, "key"), "bands")
    # of a base and its copies the base shares most bands with the others, so it makes the best hub
    size = live.df.groupBy("key").agg(F.count("*").alias("n"))
    weight = Stored(live.df.join(size, "key").groupBy("rep").agg(F.sum("n").alias("weight")), "weight")

    ids = live.df.select("rep").distinct()
    cand_reps = Stored(reps.df.drop("few").join(ids, "rep"), "cand")
    texts = d.join(cand_reps.df.select(F.col("first").alias("doc_id")).distinct(), "doc_id").select("doc_id", "text")
    sets = Stored(texts.mapInArrow(_sets(k), "id long, x binary").dropDuplicates(["id"]), "sets")
    first = Stored(reps.df.select("rep", "first"), "first")
    reps.drop()

    def labelled(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
        if comp is None:
            return rows.withColumn("c", F.col("rep"))
        return rows.join(comp.select(F.col("u").alias("rep"), "component"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("c"))

    edges: list[Stored] = []
    tested: list[Stored] = []
    comp = None
    for turn in range(HUB_ROUNDS):
        now = labelled(live.df, comp)
        # equal keys with one component left need no look
        order = F.struct((-F.col("weight") if turn == 0 else F.xxhash64(F.lit(turn), "rep")).alias("o"), "rep", "c")
        now = now.join(weight.df, "rep")
        hubs = now.groupBy("key").agg(F.min(order).alias("hub"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key", "hub.rep", "hub.c").toDF("key", "hub", "hc")
        pairs = now.select("key", "rep", "c").join(hubs, "key").where("c <> hc").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
        for t in tested:
            pairs = pairs.join(t.df, ["a", "b"], "left_anti")
        tested.append(Stored(pairs, "tested"))
        found = Stored(_verify(tested[-1].df, cand_reps.df, sets.df, percent), "edges")
        edges.append(found)
        if found.df.isEmpty() and turn:
            break
        comp = _all(edges, comp)
    # what is still apart: groups of keys that touch each other, all pairs of each, block by block
    now = Stored(labelled(live.df, comp), "apart")
    keys = now.df.groupBy("key").agg(F.min("rep").alias("hub"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("key_parts"), F.count("*").alias("n")).where("lo <> hi and n > 2").select("key", "hub", "key_parts")
    rest = now.df.join(keys, "key")
    group = Stored(components(rest.select(F.col("rep").alias("u"), F.col("hub").alias("v"))), "groups")
    size = group.df.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    together = F.col("parts") <= TOGETHER
    member = rest.join(group.df.withColumnRenamed("u", "rep"), "rep").join(size, "component")
    member = member.select(together.alias("together"), F.when(together, F.col("component")).otherwise(F.col("key")).alias("unit"), F.when(together, F.col("parts")).otherwise(F.col("key_parts")).alias("parts"), "rep", "c").distinct()
    member = member.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    member = member.select("together", "unit", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "c")
    held = cand_reps.df.select("rep", "n_shingles", "regs").join(sets.df.withColumnRenamed("id", "rep"), "rep")
    blocks = member.join(held, "rep").groupBy("together", "unit", "i", "j").applyInArrow(_block_links(percent), "a long, b long")
    edges.append(Stored(blocks, "edges"))
    if not edges[-1].df.isEmpty():
        comp = _all(edges, comp)
    group.drop()
    for s in (live, weight, sets, cand_reps, now, *tested):
        s.drop()
    out = sig.df.drop("regs", "few")
    if comp is None:
        found = first.df.select(F.col("rep").alias("cls"), F.col("first").alias("component"))
    else:  # a component is named by its least doc_id
        c = comp.select(F.col("u").alias("rep"), F.col("component").alias("label"))
        named = c.join(first.df, "rep").groupBy("label").agg(F.min("first").alias("least"))
        found = first.df.join(c.join(named, "label"), "rep", "left").select(F.col("rep").alias("cls"), F.coalesce("least", "first").alias("component"))
    out = out.join(found, "cls", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    out = out.withColumn("component_id", own)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "cls")


def _all(edges: list[Stored], _: DataFrame | None) -> DataFrame | None:
    e = edges[0].df
    for x in edges[1:]:
        e = e.union(x.df)
    return components(e.select(F.col("a").alias("u"), F.col("b").alias("v")))


def _with_class(at: int, k: int):
    def run(batches):
        for b in batches:
            for i, j, buf, off in tk.text_blocks(b.column(at)):
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, pa.array(_class_ids(*shingle_sets(buf, off, k)))], names=[*b.schema.names, "near_cls"])

    return run


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates, with the columns of docs: that of the smallest doc_id.
    Rows repeated under one doc_id are copies too, if their sets are the same: one stays."""
    found = Stored(_near_duplicates(docs, k, percent), "kept")
    by_id = Stored(found.df.groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")).where("n > 1 or not kept"), "kept-ids")
    out = docs.join(by_id.df.where("doc_id is not null").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    twice = by_id.df.where("n > 1 and kept and doc_id is not null").select("doc_id")
    if twice.isEmpty():
        return out
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.join(twice, "doc_id", "left_semi").select(docs.columns).toDF(*names)
    schema = StructType([*rows.schema.fields, StructField("near_cls", LongType())])
    mine = rows.withColumn(names[docs.columns.index("text")], F.col(names[docs.columns.index("text")]).cast("string")).mapInArrow(_with_class(docs.columns.index("text"), k), schema)
    keep = found.df.where("kept").select(F.col("doc_id").alias(names[docs.columns.index("doc_id")]), F.col("cls").alias("near_cls")).distinct()
    own = [names[docs.columns.index("doc_id")], "near_cls"]
    return out.unionByName(mine.join(keep, own, "left_semi").dropDuplicates(own).select(names).toDF(*docs.columns))
