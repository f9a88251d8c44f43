"""Operator 5: benchmark decontamination by SimHash over item-sized windows.

Words are runs of letters, digits and characters beyond ASCII, lower-cased.  For an
item of L words every window of L words of a text is a candidate.  A window's
fingerprint is the 64-bit SimHash of its five-word shingles, weighted by their count.
Windows meet items through a multi-index: a fingerprint is BLOCKS keys of 16 bits, and of
two fingerprints within RADIUS bits one key at least differs in FLIP = RADIUS // BLOCKS
bits at most, so looking each key up among an item length's sorted keys, with all its
flips (or passing over the distinct keys, where these are fewer), misses none within the
radius; of random pairs it lets one in seven through.  Pairs within the radius are judged
exactly: the sum of the smaller counts of each shingle over that of the larger must reach
THRESHOLD.  At similarity 0.8 two windows without repeated shingles lie 9.7 bits apart
(deviation 2.9), so the radius loses some 0.03 % of those just at the threshold; where one
shingle fills a ninth of a window it may lose some per cent.

A window that holds too few shingles of any item cannot reach the threshold, and is
passed over before it is fingerprinted.  Items go to the tasks in chunks of CHUNK items or
CHUNK_WORDS words, one pass over the texts each, whose result is written before the next
begins: a large benchmark needs more passes, not more memory.

Defined results: null and empty texts and items without words match nothing; a text
shorter than an item is one window; items under five words are one shingle, as many
words long; of equally similar windows the first is given; a very long text is read
whole (memory follows the longest one); repeated items and rows each get their rows; null
ids are kept; other columns are not looked at, and drop_contaminated() keeps them all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from lodestream.llm import textkernel as tk
from lodestream.llm.common import Stored, require

RADIUS, BLOCKS, THRESHOLD, SHINGLE = 19, 4, 0.8, 5
FLIP = RADIUS // BLOCKS
CHUNK, CHUNK_WORDS = 20_000, 4_000_000
_BITS = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)
#: All keys of FLIP bits or fewer: what a key is changed by to reach the keys near it.
_FLIPS = np.flatnonzero(_BITS <= FLIP).astype(np.uint16)


def simhash(shingles: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Fingerprints of the rows of a matrix of shingle hashes; mask: which entries count."""
    out = np.zeros(len(shingles), np.uint64)
    n = np.full(len(shingles), shingles.shape[1]) if mask is None else mask.sum(1)
    for b in range(64):
        bit = ((shingles >> np.uint64(b)) & np.uint64(1)).astype(bool)
        out |= (2 * (bit if mask is None else bit & mask).sum(1) > n).astype(np.uint64) << np.uint64(b)
    return out


class Items:
    """The items of one chunk that are k words to the shingle, indexed."""

    def __init__(self, ids: np.ndarray, shingles: list[np.ndarray], sizes: np.ndarray, k: int):
        self.ids, self.k, self.sizes = ids, k, sizes
        self.bags = [np.unique(s, return_counts=True) for s in shingles]
        self.all = np.unique(np.concatenate(shingles))
        self.light = np.zeros(1 << 20, bool)  # a first look by 20 bits
        self.light[self.all & np.uint64((1 << 20) - 1)] = True
        self.prints = np.array([simhash(s[None, :])[0] for s in shingles], np.uint64)
        self.lengths = np.unique(sizes)
        self.index = {n: Index(self.prints, np.flatnonzero(sizes == n)) for n in self.lengths.tolist()}


class Index:
    """The fingerprints of some items by each of their keys."""

    def __init__(self, prints: np.ndarray, rows: np.ndarray):
        self.prints, self.rows = prints, rows
        own = prints[rows].view(np.uint16).reshape(-1, BLOCKS)
        self.order = [np.argsort(own[:, b], kind="stable") for b in range(BLOCKS)]
        self.keys, self.at = [], []
        for b in range(BLOCKS):
            k, n = np.unique(own[:, b], return_counts=True)
            self.keys.append(k)
            self.at.append(np.r_[0, np.cumsum(n)])

    def _near_keys(self, b: int, probes: np.ndarray):
        """Pairs (probe, key) that differ in FLIP bits or fewer."""
        keys = self.keys[b]
        flips = len(keys) > len(_FLIPS)
        if flips:
            place = np.full(1 << 16, -1, np.int32)
            place[keys] = np.arange(len(keys))
        step = max(1, (1 << 22) // min(len(keys), len(_FLIPS)))
        for lo in range(0, len(probes), step):
            p = probes[lo : lo + step, None]
            if flips:
                k = place[p ^ _FLIPS]
                i, j = np.nonzero(k >= 0)
                yield lo + i, k[i, j]
            else:
                i, k = np.nonzero(_BITS[p ^ keys] <= FLIP)
                yield lo + i, k

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of fingerprint and item within the radius, each once."""
        parts = prints.view(np.uint16).reshape(-1, BLOCKS)
        got = []
        for b in range(BLOCKS):
            probes, of = np.unique(parts[:, b], return_inverse=True)
            who = np.argsort(of, kind="stable")
            at = np.r_[0, np.cumsum(np.bincount(of, minlength=len(probes)))]
            for i, k in self._near_keys(b, probes):
                # every item of the key with every fingerprint of the probe
                n, m = at[i + 1] - at[i], self.at[b][k + 1] - self.at[b][k]
                pair = np.repeat(np.arange(len(i)), n * m)
                rest = np.arange(len(pair)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
                w = who[at[i][pair] + rest // m[pair]]
                x = self.rows[self.order[b][self.at[b][k][pair] + rest % m[pair]]]
                d = prints[w] ^ self.prints[x]
                ok = np.bitwise_count(d) <= RADIUS
                got.append(w[ok] * len(self.prints) + x[ok])
        code = np.unique(np.concatenate(got)) if got else np.zeros(0, np.int64)
        return code // len(self.prints), code % len(self.prints)


def build_items(benchmark: DataFrame, chunk: int = CHUNK):
    """Chunks of indexed items; the driver holds one while it makes the next."""
    require(benchmark, "item_id", "text")
    pending, held, words = [], 0, 0
    for batch in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator(prefetchPartitions=False):
        pending.append((batch["item_id"], batch["text"]))
        held, words = held + 1, words + batch["text"].count(" ") + 1
        if held >= chunk or words >= CHUNK_WORDS:
            yield _index(pending)
            pending, held, words = [], 0, 0
    if pending:
        yield _index(pending)


def _index(pairs: list[tuple[int, str]]) -> list[Items]:
    buf, off = tk.column(pa.array([t for _, t in pairs], pa.large_string()))
    h, doc = tk.words(buf, off, tk.ALNUM)
    at = np.r_[0, np.cumsum(tk.counts(doc, len(pairs)))]
    by_k: dict[int, list] = {}
    for i, (item, _) in enumerate(pairs):
        w = h[at[i] : at[i + 1]]
        if len(w):
            k = min(SHINGLE, len(w))
            by_k.setdefault(k, []).append((item, tk.grams(w, np.zeros(len(w), np.int64), k)[0], len(w)))
    return [Items(np.array([x[0] for x in v], object), [x[1] for x in v], np.array([x[2] for x in v]), k) for k, v in sorted(by_k.items())]


def _similar(bag: tuple[np.ndarray, np.ndarray], row: np.ndarray) -> float:
    a, n = bag
    b, m = np.unique(row, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    least = np.minimum(n[i], m[j]).sum()
    return float(least / (n.sum() + m.sum() - least))


def _scan(h: np.ndarray, doc: np.ndarray, n_docs: int, it: Items):
    """(text, item row, similarity, first word, words) of every match."""
    g, whole = tk.grams(h, doc, it.k)
    hit = np.zeros(len(g), bool)
    maybe = np.flatnonzero(it.light[g & np.uint64((1 << 20) - 1)] & whole)
    if not len(maybe):
        return
    x = g[maybe]
    hit[maybe] = it.all[np.minimum(np.searchsorted(it.all, x), len(it.all) - 1)] == x
    pos = np.flatnonzero(hit)
    if not len(pos):
        return
    seen = np.r_[0, np.cumsum(hit)]
    at = np.r_[0, np.cumsum(tk.counts(doc, n_docs))]
    d = doc[pos]
    begin, end = at[d], at[d + 1]
    for length in it.lengths.tolist():
        m = length - it.k + 1  # shingles in a window
        lo, hi = np.maximum(begin, pos - m + 1), np.minimum(pos, np.maximum(begin, end - length))
        # runs of window starts around each hit, merged, so that each start comes once
        a = np.maximum(lo, np.r_[0, np.maximum.accumulate(hi + 1)[:-1]])
        n = np.maximum(hi - a + 1, 0)
        starts = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own = np.repeat(d, n)
        stop = np.minimum(starts + m, at[own + 1] - it.k + 1)
        ok = (seen[stop] - seen[starts]) >= THRESHOLD * m
        starts, stop, own = starts[ok], stop[ok], own[ok]
        index = it.index[length]
        step = max(16, min(4096, (1 << 21) // len(index.rows)))
        for c in range(0, len(starts), step):
            s, e, o = starts[c : c + step], stop[c : c + step], own[c : c + step]
            idx = s[:, None] + np.arange(m)
            mask = idx < e[:, None]
            rows = g[np.minimum(idx, len(g) - 1)]
            w, i = index.near(simhash(rows, mask))
            for x, y in zip(w.tolist(), i.tolist(), strict=True):
                sim = _similar(it.bags[y], rows[x][mask[x]])
                if sim >= THRESHOLD:
                    yield int(o[x]), y, sim, int(s[x] - at[o[x]]), int(e[x] - s[x]) + it.k - 1


def matches(docs: DataFrame, benchmark: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each row of docs and item that it holds: doc_id, item_id, the best window's
    similarity, its first word (from 0) and its number of words."""
    require(docs, "doc_id", "text")
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    item_arrow = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = f"doc_id {id_type}, item_id {item_type}, similarity double, first_word long, n_words long"
    out = None
    for items, several in _one_ahead(build_items(benchmark, chunk)):

        def run(batches, items=items):
            for b in batches:
                ids, got = b.column(0), []
                for i, j, buf, off in tk.text_blocks(b.column(1)):
                    h, doc = tk.words(buf, off, tk.ALNUM)
                    best: dict[tuple[int, int, int], tuple] = {}
                    for which, it in enumerate(items):
                        for o, y, sim, first, n in _scan(h, doc, j - i, it):
                            if (key := (o, which, y)) not in best or (sim, -first) > (best[key][0], -best[key][1]):
                                best[key] = (sim, first, n)
                    got += [(ids[i + o], items[w].ids[y], *v) for (o, w, y), v in sorted(best.items())]
                if got:
                    cols = list(zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in cols[0]], b.schema.types[0]), pa.array(list(cols[1]), item_arrow), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        part = Stored(part, "contaminated").df if several else part
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _one_ahead(chunks):
    """Each chunk, and whether there are several. No more than two are alive."""
    first = next(chunks, None)
    if first is None:
        return
    second = next(chunks, None)
    yield first, second is not None
    while second is not None:
        del first
        first, second = second, next(chunks, None)
        yield first, True


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The rows of docs that hold no item, with all their columns; decided row by row, with no join."""
    require(docs, "text")
    at, kept = docs.columns.index("text"), docs
    last = None
    for items, several in _one_ahead(build_items(benchmark, chunk)):

        def run(batches, items=items):
            for b in batches:
                bad = np.zeros(b.num_rows, bool)
                for i, j, buf, off in tk.text_blocks(b.column(at)):
                    h, doc = tk.words(buf, off, tk.ALNUM)
                    for it in items:
                        for o, *_ in _scan(h, doc, j - i, it):
                            bad[i + o] = True
                yield b.filter(pa.array(~bad))

        kept = kept.mapInArrow(run, docs.schema)
        if several:
            now = Stored(kept, "clean")
            if last is not None:
                last.drop()
            kept, last = now.df, now
    return kept
