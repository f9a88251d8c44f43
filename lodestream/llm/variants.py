"""Operator 11: spelling variants, found by Levenshtein automata of distance one run against broadcast shards of a trie.

The words, counted, are sorted by (length, word) and cut into shards of SHARD_WORDS words and SHARD_BYTES at most,
each a compact trie: arrays of nodes in breadth-first order, where a word's letters beyond its last branch are not nodes
but stay a tail.  Shards are broadcast ROUND_BYTES at a time and freed again.  A task takes blocks of words through
each shard depth-first: a block goes down its words' own path, and at every node the automaton's single edit (another
letter, one more or one less) is taken and what follows is read exactly to its end before the path goes on.
Words whose length cannot fit what lies below a node leave it.  A neighbour that is reached by
several edits (one letter of a run of equal ones more or less) is reached by the last of them alone, so each is
emitted once.  Tasks reduce each word's neighbours to their number and the best one, as does the aggregation after them.

Memory: a task holds a block of words, the shards of a round and what one block reaches at one depth; the driver holds a
round's shards.  Time follows words times shards, but a shard whose lengths or first letters are others ends at once.

Defined results: null texts hold no words; a null doc_id hashes as an empty one; repeated rows count each; very long words are
whole (a shard may then hold a single one, and the walk takes a step a letter); of best neighbours with one count the
smallest in code-point order is the form; an empty table gives an empty one; other columns are ignored."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import Stored, require

SHARD_WORDS, SHARD_BYTES, ROUND_BYTES = 100_000, 2 << 20, 64 << 20
#: Words of a task, and of a block that goes down a trie together.
TASK_WORDS, BLOCK = 10_000, 4096
RUN = "[A-Za-z\\u00C0-\\u00FF]"


def lower_run(c: Column) -> Column:
    """A-Z lowered alone; runs of plain ASCII take the short way."""
    plain = F.octet_length(c) == F.length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def count_words(docs: DataFrame, least_length: int = 7, least_count: int = 2, damage: int = 31) -> DataFrame:
    """word, n: runs of letters of whole texts, one letter of one in `damage` (by hash of document and run) deleted."""
    require(docs, "doc_id", "text")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", lower_run(F.col("run")).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % damage == 0, less).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters (all are below U+0100), one after the other, and where each word starts."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8), np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]


def _agree(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many letters agree from a[i] and b[j] on, `most` at most."""
    n = np.zeros(len(i), np.int64)
    live = np.flatnonzero(most > 0)
    k = 0
    while len(live):
        live = live[a[i[live] + k] == b[j[live] + k]]
        k += 1
        n[live] = k
        live = live[most[live] > k]
    return n


class Trie:
    """Words in order of (length, word): letters, starts, n; nodes in breadth-first order, so that a node's children follow
    one another: label, first (of its children), word (that ends in the node or in its tail, or -1), and the least and
    greatest length of what follows below."""

    FIELDS = (("letters", np.uint8), ("starts", np.int64), ("n", np.int64), ("label", np.uint8), ("first", np.int32), ("word", np.int32), ("low", np.int32), ("high", np.int32))

    def __init__(self, **arrays):
        self.__dict__ |= arrays
        parent = np.repeat(np.arange(len(self.label)), np.diff(self.first))
        self.keys = parent * 256 + self.label[1:]  # of the nodes from 1 on, ascending

    @classmethod
    def of(cls, words: list[str], n: np.ndarray) -> Trie:
        order = sorted(range(len(words)), key=words.__getitem__)
        letters, starts = _flat(words)
        o = np.array(order, np.int64)
        at, size = starts[:-1][o], np.diff(starts)[o]
        same = _agree(letters, at[:-1], letters, at[1:], np.minimum(size[:-1], size[1:]))
        before, after = np.r_[0, same], np.r_[same, 0]
        end = np.minimum(size, np.maximum(before, after) + 1)  # where a word leaves all others
        made = before + 1
        made[0] = 1
        label, word, parents, levels, owner = [np.zeros(1, np.uint8)], [np.full(1, -1, np.int64)], [], [0, 1], np.zeros(1, np.int64)
        if len(o) == 1:
            end[0] = min(1, size[0])
        if len(o) and (end == 0).any():
            word[0][0] = o[0]
        d, live = 1, np.arange(len(o))
        while len(live := live[end[live] >= d]):
            new = live[made[live] <= d]
            parents.append(levels[-2] + np.searchsorted(owner, new, "right") - 1)
            label.append(letters[at[new] + d - 1])
            word.append(np.where(end[new] == d, o[new], -1))
            levels.append(levels[-1] + len(new))
            owner, d = new, d + 1
        label, word = np.concatenate(label), np.concatenate(word)
        parent = np.concatenate(parents) if parents else np.zeros(0, np.int64)
        first = np.searchsorted(parent, np.arange(len(label) + 1)) + 1
        depth = np.repeat(np.arange(len(levels) - 1), np.diff(levels))
        left = np.where(word >= 0, np.diff(starts)[np.maximum(word, 0)] - depth, 0) if len(o) else np.zeros(1, np.int64)
        low, high = np.where(word >= 0, left, 1 << 30), np.where(word >= 0, left, -1)
        for a, e in zip(levels[-2:0:-1], levels[:1:-1], strict=True):  # a level's nodes to their parents
            up = parent[a - 1 : e - 1]
            cut = np.flatnonzero(np.r_[True, up[1:] != up[:-1]])
            low[up[cut]] = np.minimum(low[up[cut]], np.minimum.reduceat(low[a:e], cut) + 1)
            high[up[cut]] = np.maximum(high[up[cut]], np.maximum.reduceat(high[a:e], cut) + 1)
        return cls(letters=letters, starts=starts, n=n, label=label, first=first.astype(np.int32), word=word.astype(np.int32), low=low.astype(np.int32), high=high.astype(np.int32))

    def packed(self) -> bytes:
        parts = [np.ascontiguousarray(getattr(self, k), kind).tobytes() for k, kind in self.FIELDS]
        return b"".join([struct.pack(f"<{len(parts)}q", *map(len, parts)), *parts])

    @classmethod
    def unpacked(cls, data: bytes) -> Trie:
        sizes, at, out = struct.unpack_from(f"<{len(cls.FIELDS)}q", data), 8 * len(cls.FIELDS), {}
        for (k, kind), size in zip(cls.FIELDS, sizes, strict=True):
            out[k] = np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at)
            at += size
        return cls(**out)

    def lengths(self) -> tuple[int, int]:
        return int(self.low[0]), int(self.high[0])

    def neighbours(self, letters: np.ndarray, starts: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (a word of the block, a word of the shard) that are one edit apart. letters, starts: of the block's words."""
        q, size = block, np.diff(starts)
        node, pos, found = np.zeros(len(q), np.int64), 0, []
        while len(q):
            rest = size[q] - pos
            near = (rest >= self.low[node] - 1) & (rest <= self.high[node] + 1)
            q, node, rest = q[near], node[near], rest[near]
            leaf = self.first[node] == self.first[node + 1]
            found.append(self._tails(letters, starts, q[leaf], node[leaf], pos))
            q, node, rest = q[~leaf], node[~leaf], rest[~leaf]
            # what the word has at this place and after it; 256 and 257 beyond its end
            here = np.where(rest > 0, letters[np.minimum(starts[q] + pos, len(letters) - 1)], 256)
            then = np.where(rest > 1, letters[np.minimum(starts[q] + pos + 1, len(letters) - 1)], 257)
            less = (rest > 0) & (here != then)  # one letter less; the last of a run of equal ones
            found.append(self._exactly(letters, starts, q[less], node[less], np.full(int(less.sum()), pos + 1)))
            fan = self.first[node + 1] - self.first[node]
            at = np.repeat(np.arange(len(q)), fan)
            child = self.first[node][at] + np.arange(len(at)) - np.repeat(np.cumsum(fan) - fan, fan)
            own = self.label[child] == here[at]
            other, oc = at[~own], child[~own]
            found.append(self._exactly(letters, starts, q[other], oc, np.full(len(oc), pos)))  # one more
            another = rest[other] > 0
            found.append(self._exactly(letters, starts, q[other[another]], oc[another], np.full(int(another.sum()), pos + 1)))
            q, node, pos = q[at[own]], child[own], pos + 1
        return np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)]), np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)])

    def _exactly(self, letters, starts, q, node, pos) -> tuple[np.ndarray, np.ndarray]:
        """What is left of each word is read from its node on without another edit."""
        qs, ws = [], []
        while len(q):
            rest = starts[q + 1] - starts[q] - pos
            fits = (rest >= self.low[node]) & (rest <= self.high[node])
            q, node, pos, rest = q[fits], node[fits], pos[fits], rest[fits]
            leaf = self.first[node] == self.first[node + 1]
            a, w = q[leaf], self.word[node[leaf]].astype(np.int64)
            same = _agree(letters, starts[a] + pos[leaf], self.letters, self.starts[w + 1] - rest[leaf], rest[leaf]) == rest[leaf]
            ends = ~leaf & (rest == 0)
            ends[ends] = self.word[node[ends]] >= 0
            qs += [a[same], q[ends]]
            ws += [w[same], self.word[node[ends]].astype(np.int64)]
            go = ~leaf & (rest > 0)
            q, node, pos = q[go], node[go], pos[go]
            want = node * 256 + letters[starts[q] + pos]
            k = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[k] == want
            q, node, pos = q[hit], k[hit] + 1, pos[hit] + 1
        return np.concatenate(qs or [np.zeros(0, np.int64)]), np.concatenate(ws or [np.zeros(0, np.int64)])

    def _tails(self, letters, starts, q, node, pos: int) -> tuple[np.ndarray, np.ndarray]:
        """Words at a leaf without an edit so far, whose one edit lies in its tail."""
        w = self.word[node].astype(np.int64)
        i, r = starts[q] + pos, starts[q + 1] - starts[q] - pos
        s = self.high[node].astype(np.int64)
        j = self.starts[w + 1] - s
        k = _agree(letters, i, self.letters, j, np.minimum(r, s))
        i, j, rest = i + k + (r >= s), j + k + (s >= r), np.minimum(r, s) - k - (r == s)
        ok = rest >= 0  # below 0: the word itself
        ok[ok] = _agree(letters, i[ok], self.letters, j[ok], rest[ok]) == rest[ok]
        return q[ok], w[ok]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted words as packed tries, with their lengths."""

    def out(words: list[str], n: list[int]) -> pa.RecordBatch:
        t = Trie.of(words, np.array(n, np.int64))
        return pa.RecordBatch.from_pydict({"least": [len(words[0])], "first": [words[0]], "trie": [t.packed()]}, schema=pa.schema([("least", pa.int32()), ("first", pa.string()), ("trie", pa.binary())]))

    words, n, size = [], [], 0
    for b in batches:
        for word, count in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if words and (len(words) >= SHARD_WORDS or size + len(word) > SHARD_BYTES):
                yield out(words, n)
                words, n, size = [], [], 0
            words.append(word)
            n.append(count)
            size += len(word)
    if words:
        yield out(words, n)


def _best(words: list[str], letters: np.ndarray, starts: np.ndarray, tries: list[Trie]) -> Iterator[tuple]:
    """index, number of neighbours, the best one's count and word, of each word that has any. tries: in order of (length, word)."""
    size = np.diff(starts)
    by_size = np.argsort(size, kind="stable")
    for lo in range(0, len(words), BLOCK):
        block = by_size[lo : lo + BLOCK]
        qs, ts, ws = [], [], []
        for i, t in enumerate(tries):
            low, high = t.lengths()
            if len(near := block[(size[block] >= low - 1) & (size[block] <= high + 1)]):
                q, w = t.neighbours(letters, starts, near)
                qs.append(q)
                ts.append(np.full(len(q), i))
                ws.append(w)
        if not qs or not len(q := np.concatenate(qs)):
            continue
        t, w = np.concatenate(ts), np.concatenate(ws)
        n, length = np.empty(len(q), np.int64), np.empty(len(q), np.int64)
        for i in np.unique(t):
            at = t == i
            n[at], length[at] = tries[i].n[w[at]], np.diff(tries[i].starts)[w[at]]
        o = np.lexsort((w, t, length, -n, q))  # of one length, the order of shards and words is that of code points
        q, t, w, n, length = q[o], t[o], w[o], n[o], length[o]
        edge = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        count = np.diff(np.r_[edge, len(q)])
        # a length's first among those of the greatest count: three lengths at most
        first = np.flatnonzero((n == np.repeat(n[edge], count)) & np.r_[True, (q[1:] != q[:-1]) | (length[1:] != length[:-1]) | (n[1:] != n[:-1])])
        best: dict[int, str] = {}
        for i in first.tolist():
            trie = tries[t[i]]
            word = trie.letters[trie.starts[w[i]] : trie.starts[w[i] + 1]].tobytes().decode("latin-1")
            best[int(q[i])] = min(word, best.get(int(q[i]), word))
        yield from zip(q[edge].tolist(), count.tolist(), n[edge].tolist(), best.values(), strict=True)


_FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _walk(shards: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = None
        for b in batches:
            tries = tries or [Trie.unpacked(s.value) for s in shards]
            words = b.column(0).to_pylist()
            letters, starts = _flat(words)
            if rows := list(_best(words, letters, starts, tries)):
                i, near, n, best = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in i]), pa.array(near, pa.int64()), pa.array(n, pa.int64()), pa.array(best, pa.string())], schema=_FOUND)

    return run


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: words (word, n) that have neighbours among them."""
    spark = words.sparkSession
    count, size = words.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    tasks = max(1, math.ceil(max(count / SHARD_WORDS, size / SHARD_BYTES)))
    ranged = words.withColumn("l", F.length("word")).repartitionByRange(tasks, "l", "word").sortWithinPartitions("l", "word").select("word", "n")
    shards = Stored(ranged.mapInArrow(_shards, "least int, first string, trie binary").withColumn("size", F.length("trie")), "variant-shards")
    asked = words.repartition(max(1, math.ceil(count / TASK_WORDS)), "word").select("word")
    found = None
    sizes = shards.df.select("least", "first", "size").orderBy("least", "first").toLocalIterator()
    for low, high in _rounds(sizes):
        at = F.struct("least", "first")
        these = shards.df.where((at >= F.struct(F.lit(low[0]).alias("least"), F.lit(low[1]).alias("first"))) & (at <= F.struct(F.lit(high[0]).alias("least"), F.lit(high[1]).alias("first"))))
        sent = [spark.sparkContext.broadcast(bytes(r.trie)) for r in these.orderBy("least", "first").select("trie").collect()]  # ROUND_BYTES
        part = Stored(asked.mapInArrow(_walk(sent), "word string, n_near long, best_n long, best string"), "variant-near").df
        for s in sent:
            s.destroy()
        found = part if found is None else found.unionByName(part)
    shards.drop()
    if found is None:
        return words.select("word", F.lit(0).cast("long").alias("n_near"), F.lit(0).cast("long").alias("best_n"), "word").toDF("word", "n_near", "best_n", "best").where("false")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def _rounds(sizes: Iterator) -> Iterator[tuple]:
    """The first and last shard of each round, ROUND_BYTES at most or a single one."""
    first = last = None
    total = 0
    for r in sizes:
        if first is not None and total + r["size"] > ROUND_BYTES:
            yield first, last
            first, total = None, 0
        last = (r["least"], r["first"])
        first = first or last
        total += r["size"]
    if first is not None:
        yield first, last


def group_variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n): the form is the commonest neighbour, if it is `factor` times as
    common; the root is where the forms lead."""
    require(words, "word", "n")
    near = near_words(words)
    d = Stored(words.select("word", "n").join(near, "word", "left").withColumn("ok", F.col("best_n") >= factor * F.col("n"))
               .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("ok"), F.col("best")).alias("form"), F.when(F.col("ok"), F.col("best_n")).alias("form_n")), "variant-forms").df
    roots = Stored(d.where("form is not null").select("word", F.col("form").alias("root")), "variant-roots")
    while True:  # each round doubles the steps taken; counts grow by `factor` a step, so there are few
        up = roots.df.select(F.col("word").alias("root"), F.col("root").alias("next"))
        nxt = Stored(roots.df.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        moved = not nxt.df.where("moved").isEmpty()
        roots.drop()
        roots = nxt
        if not moved:
            break
    return d.join(roots.df.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, **options) -> DataFrame:
    """group_variants() of the words of docs."""
    return group_variants(Stored(count_words(docs, **options), "variant-words").df)
