"""Operator 7: exact repeated substrings by blockwise suffix sorting with a difference cover.

Every string of LENGTH bytes is the head of a suffix.  A head's least SEED-byte string
(by hash, the leftmost if several) names its suffix bucket, so equal heads fall in one
bucket.  Texts are kept in blocks; first the blocks' seeds alone are sent, to find those
that lie in more than one text, since the others' heads cannot repeat.  Runs of heads
with such a seed then travel as one piece of text; equal pieces of a block travel once,
with the places where they occur.  Buckets are handled one group at a time, each with
its text alone in memory.

Within a bucket only seeds that lie in several documents and in different pieces need
sorting.  Positions whose residue mod V is in the cover D are sampled, and ranked by
prefix doubling.  Suffixes of one bucket (seed and offset) with equal first V bytes are
long ties; any two of them reach sampled positions together within V steps, whose ranks
decide, so each suffix's place is a count of the smaller ones in every residue class.
Neighbours in that order are compared over all LENGTH bytes: equal ones form a class,
and each place of a class in a document with a larger id than the class's least one is
removed.

Defined results: a null text is empty; rows without doc_id neither lose bytes nor make
others lose them; rows repeated under one doc_id don't remove each other's bytes;
texts under LENGTH bytes stay whole."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestream.llm import textkernel as tk
from lodestream.llm.blocks import LEVEL, give_back, pack, small, unpack
from lodestream.llm.common import Stored, pieces, require

LENGTH, SEED = 50, 16
TEXT_BYTES = 1 << 19
BLOCK_BYTES = 3 << 20
BUCKET_BYTES = 3 << 20
#: Pieces whose bytes are indexed at a time.
STEP = 1 << 14
#: Heads of places that are judged at a time.
HEADS = 1 << 20
V = 7
#: A difference cover mod 7: every difference is one of two members.
D = (0, 1, 3)
_SHIFT = np.array([[next(d for d in range(V) if (a + d) % V in D and (b + d) % V in D) for b in range(V)] for a in range(V)])


def _word(buf: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    return np.ndarray((max(len(buf) - 7, 0),), f"{order}u8", buf, strides=(1,))


def _seed_hash(buf: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    w = _word(buf)
    a, b = (w[:-8], w[8:]) if at is None else (w[at], w[at + 8])
    return tk.mix(a * tk.U(0x9E3779B97F4A7C15) ^ tk.mix(b + tk.U(0x632BE59BD9B4E019)))


def cut(buf: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of heads with one seed: first byte, end, offset of the seed, text index, seed hash."""
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none, none, none, none.astype(np.uint64)
    h = _seed_hash(buf)
    w = length - SEED + 1
    m = (h & tk.U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < w:
        m = np.minimum(m[: len(m) - (w - span)], m[w - span :])
    seed = (m & tk.U(0xFFFFFFFF)).astype(np.uint32)
    size = np.diff(off)
    n_heads = np.maximum(size - length + 1, 0)
    head = np.repeat(np.tile([True, False], len(size)), np.column_stack([n_heads, size - n_heads]).ravel())[: len(seed)]
    turn = np.ones(len(seed) + 1, bool)  # no run goes on past this
    turn[1:-1] = (seed[1:] != seed[:-1]) | ~head[1:] | ~head[:-1]
    a, e = np.flatnonzero(head & turn[:-1]), np.flatnonzero(head & turn[1:]) + length
    p = seed[a].astype(np.int64)
    return a, e, p - a, np.searchsorted(off, a, "right") - 1, h[p]


def _gather_bytes(buf: np.ndarray, a: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.empty(int(n.sum()), np.uint8)
    at = 0
    for lo in range(0, len(a), STEP):
        s, k = a[lo : lo + STEP], n[lo : lo + STEP]
        size = int(k.sum())
        out[at : at + size] = buf[np.repeat(s - (np.cumsum(k) - k), k) + np.arange(size)]
        at += size
    return out


def _span_hashes(buf: np.ndarray, a: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of pieces, a stretch of the buffer at a time where they ascend, else of what is gathered."""
    out = np.empty(len(a), np.uint64)
    for lo in range(0, len(a), STEP):
        s, t = a[lo : lo + STEP], e[lo : lo + STEP]
        base = int(s.min())
        out[lo : lo + len(s)] = tk.span_hash(buf[base : int(t.max())], s - base, t - base, lower=False)
    return out


def _alike(buf: np.ndarray, start: np.ndarray, lens: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether pieces i and other[i], of one length each, are the same bytes."""
    same = lens == lens[other]
    w = _word(buf)
    for k in range(0, int(lens.max()) if len(lens) else 0, 8):
        i = np.flatnonzero(same & (lens > k))
        x = start[i] + np.minimum(k, lens[i] - 8)
        y = start[other[i]] + np.minimum(k, lens[i] - 8)
        same[i] = w[x] == w[y]
    return same


def _classes(buf: np.ndarray, start: np.ndarray, lens: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of pieces such that equal ones (same keys, same bytes) are neighbours, and where each class starts.
    The last key is a hash of the bytes, which decides nothing by itself."""
    o = np.lexsort(keys[::-1])
    first = _starts(*[k[o] for k in keys])
    rep = np.repeat(o[first], np.diff(np.r_[first, len(o)]))
    other = np.empty(len(o), np.int64)
    other[o] = rep
    odd = np.flatnonzero(~_alike(buf, start, lens, other))
    if len(odd):  # unlike pieces under one hash: told by their bytes
        seen: dict[tuple, int] = {}
        number = np.zeros(len(o), np.int64)
        for i in odd.tolist():
            number[i] = seen.setdefault((*[int(k[i]) for k in keys], buf[start[i] : start[i] + lens[i]].tobytes()), len(seen) + 1)
        o = np.lexsort((number, *keys[::-1]))
        first = _starts(*[k[o] for k in keys], number[o])
    return o, first


def _ipc(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def _cut_all(rows: pa.Table, id_at: int, text_at: int, length: int) -> tuple[np.ndarray, ...]:
    """Pieces of all rows: first byte and end in the rows' bytes, seed offset, text index, seed."""
    known = rows.column(id_at).is_valid().to_numpy()
    buf, off = tk.column(rows.column(text_at))
    parts = []
    for i, j in tk.blocks(off, TEXT_BYTES):
        a, e, m, doc, seed = cut(buf[off[i] : off[j]], off[i : j + 1] - off[i], length)
        ok = known[i:j][doc]
        parts.append((a[ok] + off[i], e[ok] + off[i], m[ok], doc[ok] + i, seed[ok]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _seed_lists(seed: np.ndarray, doc: np.ndarray, nb: int):
    """For each bucket the distinct low halves of its seeds, whether each lies in several texts, where it begins,
    each piece's bucket and its place in the lists. Texts ascend."""
    bucket = (seed >> tk.U(17)) % tk.U(nb)
    key = (bucket << tk.U(32)) | (seed & tk.U(0xFFFFFFFF))
    o = np.argsort(key, kind="stable")
    first = _starts(key[o])
    u = key[o[first]]
    last = np.r_[first[1:], len(o)] - 1
    cuts = np.searchsorted(u >> tk.U(32), np.arange(nb + 1, dtype=np.uint64))
    inv = np.empty(len(o), np.int64)
    inv[o] = np.repeat(np.arange(len(u)), np.diff(np.r_[first, len(o)]))
    return bucket.astype(np.int64), (u & tk.U(0xFFFFFFFF)).astype(np.uint32), doc[o[first]] < doc[o[last]], cuts, inv


def _batches_of(rows: list[list]):
    for lo in range(0, len(rows[0]), 64):
        yield [x[lo : lo + 64] for x in rows]


_T0 = "batch long, bucket int, rows binary, seeds binary"


def _seed_pass(nb: int, id_at: int, text_at: int, length: int):
    """Rows in blocks of some BLOCK_BYTES of text, and each block's seeds by bucket."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        rows, size = [], 0

        def flush():
            batch = (part << 24) | seq
            _, _, _, doc, seed = _cut_all(pa.Table.from_batches(rows).combine_chunks(), id_at, text_at, length)
            out = [[batch], [None], [_ipc(rows)], [None]]
            _, low, several, cuts, _ = _seed_lists(seed, doc, nb)
            for b in np.flatnonzero(cuts[1:] > cuts[:-1]):
                x = slice(cuts[b], cuts[b + 1])
                for col, v in zip(out, (batch, int(b), None, pack([np.diff(low[x], prepend=np.uint32(0)), np.packbits(several[x])])), strict=True):
                    col.append(v)
            for c in _batches_of(out):
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.binary())], names=["batch", "bucket", "rows", "seeds"])

        for b in batches:
            _, off = tk.column(b.column(text_at))
            for i, j in tk.blocks(off, BLOCK_BYTES):
                rows.append(b.slice(i, j - i))
                size += int(off[j] - off[i])
                if size >= BLOCK_BYTES:
                    yield from flush()
                    seq += 1
                    rows, size = [], 0
        if rows:
            yield from flush()

    return run


def _live_seeds(table: pa.Table) -> pa.Table:
    """One bucket's seeds: of each block's list, which lie in several texts."""
    lists = [(np.cumsum(gaps, dtype=np.uint32), np.unpackbits(flags, count=len(gaps)).astype(bool)) for gaps, flags in map(unpack, table["seeds"].to_pylist())]
    every = np.sort(np.concatenate([x for x, _ in lists]))
    twice = every[1:][every[1:] == every[:-1]]
    live = np.unique(np.concatenate([twice, *[x[m] for x, m in lists]]))
    bits = [np.packbits(_among(live, x)).tobytes() for x, _ in lists]
    give_back()
    return pa.table({"batch": table["batch"], "bucket": table["bucket"], "live": pa.array(bits, pa.binary())})


def _among(ascending: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(x), bool)
    return ascending[np.minimum(np.searchsorted(ascending, x), len(ascending) - 1)] == x


def _piece_pass(nb: int, id_at: int, text_at: int, length: int):
    """One block of rows and its live seeds: the pieces with these, by bucket."""

    def run(table: pa.Table) -> pa.Table:
        block = next((x for x in table["rows"].to_pylist() if x is not None), None)
        got = {b: x for b, x in zip(table["bucket"].to_pylist(), table["live"].to_pylist(), strict=True) if x is not None}
        out: list[list] = [[], [], []]
        if block is not None and got:
            batch = table["batch"][0].as_py()
            rows = pa.ipc.open_stream(block).read_all().combine_chunks()
            a, e, m, doc, seed = _cut_all(rows, id_at, text_at, length)
            buf, off = tk.column(rows.column(text_at))
            bucket, low, _, cuts, inv = _seed_lists(seed, doc, nb)
            live = np.zeros(len(low), bool)
            for b, bits in got.items():
                live[cuts[b] : cuts[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(cuts[b + 1] - cuts[b])).astype(bool)
            keep = np.flatnonzero(live[inv])
            a, lens, m, doc, bucket = a[keep], (e - a)[keep], m[keep], doc[keep], bucket[keep]
            # one copy of each piece, with its places, bucket by bucket
            o, first = _classes(buf, a, lens, bucket, _span_hashes(buf, a, a + lens))
            times, rep = np.diff(np.r_[first, len(o)]), o[first]
            at = np.searchsorted(bucket[rep], np.arange(nb + 1))
            ends = np.r_[0, np.cumsum(times)]
            ids = rows.column(id_at).cast(pa.int64()).fill_null(0).to_numpy()
            for b in np.flatnonzero(at[1:] > at[:-1]):
                u, t = rep[at[b] : at[b + 1]], times[at[b] : at[b + 1]]
                places = o[ends[at[b]] : ends[at[b + 1]]]
                own, which = np.unique(doc[places], return_inverse=True)
                for col, v in zip(out, (int(b), batch, pack([_gather_bytes(buf, a[u], lens[u]), small(lens[u]), small(m[u]), small(t), own.astype(np.uint32), ids[own].view(np.uint64), small(which), small(a[places] - off[doc[places]])])), strict=True):
                    col.append(v)
        give_back()
        return pa.table({"bucket": pa.array(out[0], pa.int32()), "batch": pa.array(out[1], pa.int64()), "block": pa.array(out[2], pa.binary())})

    return run


def _starts(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _doubled_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the sampled positions' suffixes to `depth` bytes and more; elsewhere 0."""
    n = len(text) - 8 * V * V
    p = np.flatnonzero(np.isin(np.arange(n) % V, D))
    rank = np.zeros(len(text), np.int64)
    key = (_word(text, ">")[p] >> tk.U(8)).astype(np.int64)
    h = V
    while True:
        u, inv = np.unique(key, return_inverse=True)
        rank[p] = inv + 1
        if h >= depth or len(u) == len(p):
            return rank
        key = rank[p] * (len(p) + 2) + rank[p + h]
        h *= 2


def head_classes(text: np.ndarray, at: np.ndarray, bucket: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Class numbers of the length-byte heads at `at`, alike for equal ones of one bucket."""
    text = np.concatenate([text, np.zeros(8 * V * V + length + 8, np.uint8)])
    head = _word(text, ">")[at] >> tk.U(8)
    o = np.lexsort((head, bucket))
    b, hd = bucket[o], head[o]
    new = np.r_[True, (b[1:] != b[:-1]) | (hd[1:] != hd[:-1])]
    group = np.empty(len(at), np.int64)
    group[o] = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    place = start[group].astype(np.int64)
    many = np.flatnonzero((np.diff(np.r_[start, len(at)]) > 1)[group])
    if len(many):
        rank = _doubled_ranks(text, length)
        top = int(rank.max()) + 1
        p, g = at[many], group[many]
        by = [np.flatnonzero(p % V == r) for r in range(V)]
        for a in range(V):
            x = by[a]
            for c in range(V) if len(x) else ():
                y, d = by[c], _SHIFT[a, c]
                if len(y):
                    mine, their = g[x] * top + rank[p[x] + d], np.sort(g[y] * top + rank[p[y] + d])
                    place[many[x]] += np.searchsorted(their, mine) - np.searchsorted(their, g[x] * top)
    o = np.argsort(place, kind="stable")
    q, b = at[o], bucket[o]
    same = b[1:] == b[:-1]
    w = _word(text)
    for k in [*range(0, length - 8, 8), length - 8]:
        v = w[q + k]
        same &= v[1:] == v[:-1]
    out = np.empty(len(at), np.int64)
    out[o] = np.cumsum(np.r_[True, ~same]) - 1
    return out


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and rank of each of n[i] items."""
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _bucket(length: int):
    """One group of buckets: byte ranges to remove, by batch and text."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        got = [(batch, unpack(block)) for batch, block in zip(table["batch"].to_pylist(), table["block"].to_pylist(), strict=True)]
        if got:
            text = np.concatenate([g[0] for _, g in got])
            lens = np.concatenate([g[1].astype(np.int64) for _, g in got])
            m = np.concatenate([g[2].astype(np.int64) for _, g in got])
            times = np.concatenate([g[3].astype(np.int64) for _, g in got])
            src = np.repeat(np.arange(len(got), dtype=np.int32), [len(g[6]) for _, g in got])
            doc = np.concatenate([g[4][g[6]] for _, g in got])
            ids = np.concatenate([g[5][g[6]].view(np.int64) for _, g in got])
            pos = np.concatenate([g[7].astype(np.uint32) for _, g in got])
            batches = [b for b, _ in got]
            del got
            start = np.cumsum(lens) - lens
            piece = np.repeat(np.arange(len(times), dtype=np.int32), times)
            # seeds in one document alone have nothing to remove
            padded = np.concatenate([text, np.zeros(24, np.uint8)])
            _, seed = np.unique(_seed_hash(padded, start + m), return_inverse=True)
            lo, hi = np.full(seed.max() + 1, np.iinfo(np.int64).max), np.full(seed.max() + 1, np.iinfo(np.int64).min)
            first = np.cumsum(times) - times
            piece_lo, piece_hi = np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)
            np.minimum.at(lo, seed, piece_lo)
            np.maximum.at(hi, seed, piece_hi)
            live = np.flatnonzero((lo < hi)[seed])
            if len(live):
                # equal pieces of different blocks
                o, at = _classes(text, start[live], lens[live], seed[live], _span_hashes(text, start[live], (start + lens)[live]))
                same = np.empty(len(live), np.int64)
                same[o] = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(o)]))
                u = live[o[at]]
                least = np.full(len(u), np.iinfo(np.int64).max)
                np.minimum.at(least, same, piece_lo[live])
                n_heads = lens[u] - length + 1
                off = np.cumsum(n_heads) - n_heads
                own, k = _spread(n_heads)
                low = least[own]
                mixed = (np.bincount(seed[u], minlength=seed.max() + 1) > 1)[seed[u]]
                idx = np.flatnonzero(mixed[own])
                if len(idx):
                    mu = np.flatnonzero(mixed)
                    t = _gather_bytes(text, start[u[mu]], lens[u[mu]])
                    t0 = np.zeros(len(u), np.int64)
                    t0[mu] = np.cumsum(lens[u[mu]]) - lens[u[mu]]
                    cls = head_classes(t, t0[own[idx]] + k[idx], seed[u[own[idx]]] * 128 + m[u[own[idx]]] - k[idx], length)
                    best = np.full(cls.max() + 1, np.iinfo(np.int64).max)
                    np.minimum.at(best, cls, low[idx])
                    low[idx] = best[cls]
                where = np.full(len(lens), -1, np.int32)
                where[live] = same
                del own, k, same
                occ = np.flatnonzero(where[piece] >= 0)
                upto = np.cumsum(n_heads[where[piece[occ]]])
                found: list[list[np.ndarray]] = [[], [], []]
                lo = 0
                while lo < len(occ):  # places some HEADS at a time, one at least
                    hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + HEADS, "right")))
                    part = occ[lo:hi]
                    lo = hi
                    w = where[piece[part]]
                    who, j = _spread(n_heads[w])
                    gone = low[off[w][who] + j] < ids[part][who]
                    who, j = who[gone], j[gone]
                    if len(who):
                        new = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (j[1:] != j[:-1] + 1)])
                        end = np.r_[new[1:], len(who)] - 1
                        z = part[who[new]]
                        for to, v in zip(found, (z, pos[z] + j[new], pos[z] + j[end] + length), strict=True):
                            to.append(v)
                if found[0]:
                    z, a, e = map(np.concatenate, found)
                    by = np.argsort(src[z], kind="stable")
                    ranges = [doc[z][by].astype(np.uint32), a[by].astype(np.uint32), e[by].astype(np.uint32)]
                    cuts = np.r_[_starts(src[z][by]), len(by)]
                    for lo, up in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                        out.append((batches[src[z[by[lo]]]], pack([x[lo:up] for x in ranges])))
        give_back()
        return pa.table({"batch": pa.array([x for x, _ in out], pa.int64()), "block": pa.array([x for _, x in out], pa.binary())})

    return run


def merged(doc: np.ndarray, a: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal ranges from overlapping or touching ones, by text."""
    if not len(doc):
        return doc, a, e
    o = np.lexsort((a, doc))
    doc, a, e = doc[o], a[o], e[o]
    wide = int(e.max()) + 1
    reach = np.maximum.accumulate(doc * wide + e)
    new = np.r_[True, (doc[1:] != doc[:-1]) | (doc[1:] * wide + a[1:] > reach[:-1])]
    at = np.flatnonzero(new)
    return doc[at], a[at], reach[np.r_[at[1:], len(doc)] - 1] - doc[at] * wide


def _finish(make):
    """All blocks of one batch: make(rows, text, first byte, end) with the merged ranges to remove."""

    def run(table: pa.Table) -> pa.Table:
        rows = pa.ipc.open_stream(next(x for x in table["rows"].to_pylist() if x is not None)).read_all().combine_chunks()
        parts = [unpack(x) for x in table["block"].to_pylist() if x is not None]
        z = [np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3
        return make(rows, *merged(*z))

    return run


def _kept(buf: np.ndarray, off: np.ndarray, doc: np.ndarray, a: np.ndarray, e: np.ndarray) -> np.ndarray:
    step = np.zeros(len(buf) + 1, np.int32)
    np.add.at(step, off[doc] + a, 1)
    np.add.at(step, off[doc] + e, -1)
    return np.cumsum(step[:-1]) == 0


def _run(docs: DataFrame, length: int, make, schema) -> DataFrame:
    nb = pieces(docs, BUCKET_BYTES)
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")
    t0 = Stored(docs.mapInArrow(_seed_pass(nb, id_at, text_at, length), _T0), "repeat-blocks").df
    rows = t0.where("rows is not null").select("batch", "rows")
    seeds = t0.where("seeds is not null").select("batch", "bucket", "seeds")
    live = seeds.repartitionById(nb, "bucket").groupBy("bucket").applyInArrow(_live_seeds, "batch long, bucket int, live binary")
    both = rows.select("batch", F.lit(None).cast("int").alias("bucket"), "rows", F.lit(None).cast("binary").alias("live")).unionByName(live.withColumn("rows", F.lit(None).cast("binary")))
    found = both.groupBy("batch").applyInArrow(_piece_pass(nb, id_at, text_at, length), "bucket int, batch long, block binary")
    ranges = found.repartitionById(nb, "bucket").groupBy("bucket").applyInArrow(_bucket(length), "batch long, block binary")
    last = rows.withColumn("block", F.lit(None).cast("binary")).unionByName(ranges.withColumn("rows", F.lit(None).cast("binary")))
    return last.groupBy("batch").applyInArrow(_finish(make), schema)


def repeated_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    require(docs, "doc_id", "text")

    def make(rows: pa.Table, doc: np.ndarray, a: np.ndarray, e: np.ndarray) -> pa.Table:
        buf, off = tk.column(rows["text"])
        keep = _kept(buf, off, doc, a, e)
        n = rows.num_rows
        sha = [hashlib.sha256(buf[off[i] : off[i + 1]][keep[off[i] : off[i + 1]]].tobytes()).hexdigest() for i in range(n)]
        gone = np.r_[0, np.cumsum(~keep)]
        return pa.table({"doc_id": rows["doc_id"], "n_bytes": np.diff(off), "n_removed": gone[off[1:]] - gone[off[:-1]], "n_spans": np.bincount(doc, minlength=n).astype(np.int64), "kept_sha256": pa.array(sha, pa.string())})

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _run(d, length, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of docs without their repeated bytes; a range gives back the parts of characters
    at its ends, n_chars follows where there is one, and rows with nothing left go."""
    require(docs, "doc_id", "text")

    def make(rows: pa.Table, doc: np.ndarray, a: np.ndarray, e: np.ndarray) -> pa.Table:
        buf, off = tk.column(rows["text"])
        inner = (buf & 0xC0) == 0x80
        for _ in range(3):  # to whole characters: the first cut forward, the last one back
            x, y = off[doc] + a, off[doc] + e
            a = a + ((x < off[doc + 1]) & inner[np.minimum(x, len(buf) - 1)])
            e = e - ((y < off[doc + 1]) & inner[np.minimum(y, len(buf) - 1)])
        keep = _kept(buf, off, doc, a, e)
        texts = [buf[off[i] : off[i + 1]][keep[off[i] : off[i + 1]]].tobytes().decode("utf-8", "replace") for i in range(rows.num_rows)]
        touched = np.zeros(rows.num_rows, bool)
        touched[doc] = True
        left = np.array([bool(t.strip()) for t in texts], bool) | ~touched
        null = rows["text"].is_null().to_numpy()
        new = rows.set_column(rows.column_names.index("text"), rows.schema.field("text"), pa.array(texts, rows.schema.field("text").type, mask=null))
        if "n_chars" in rows.column_names:
            was = rows["n_chars"].to_pylist()
            field = rows.schema.field("n_chars")
            new = new.set_column(rows.column_names.index("n_chars"), field, pa.array([len(t) if c else w for t, c, w in zip(texts, touched, was, strict=True)], field.type))
        return new.filter(pa.array(left))

    return _run(docs, length, make, StructType(docs.schema.fields))
