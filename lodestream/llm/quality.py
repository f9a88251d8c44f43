"""Operator 1: quality classifier, a linear-chain CRF over the lines of a text.

Every line is labelled good or bad from features of itself and of its neighbours;
the text's quality is the length-weighted mean of the lines' forward-backward
marginals, put on a probability scale by a two-parameter logistic fit.

Defined results: a null or empty text, or one of line ends alone, has no line and
scores 0.0; a null doc_id is scored but never trained on (its crc32 is null, so
held_out is null); repeated rows are scored alike; very long texts are scored whole
(memory follows the longest one); other columns, whatever their names, are ignored by
quality() and kept by reject_bad(); a score of just the threshold is good.
Labels are averaged per doc_id (0.5 and more is good); null labels are skipped.
With no usable label of both kinds the score of every text with lines is 0.5."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestream.llm import textkernel as tk
from lodestream.llm.common import crc_mod, require
from lodestream.llm.crf import LinearChainCRF

#: The fit uses this many labelled texts at most, the first by a hash of doc_id.
MAX_TRAIN_DOCS = 6000
#: A text with more lines than this is scored but not used for the fit, which takes this many lines of all texts at most.
MAX_TRAIN_LINES, MAX_FIT_LINES = 2000, 400_000


def _classes(*groups: str) -> list[np.ndarray]:
    out = []
    for g in groups:
        m = np.zeros(256, bool)
        m[[ord(c) for c in g]] = True
        out.append(m)
    return out


_UPPER, _LOWER, _DIGIT, _BLANK, _STOP, _SHOUT, _SYMBOL, _PIPE = _classes(
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r", ".,;:?'\"()-", "!", "#$%&*<>{}[]=+@^~_/\\`", "|"
)
_WIDE = np.arange(256) >= 128
_CLASSES = (_UPPER, _LOWER, _DIGIT, _BLANK, _STOP, _SHOUT, _SYMBOL, _PIPE, _WIDE)
_NOT_NEWLINE = np.arange(256) != 10
_NEIGHBOUR = (0, 1, 6, 7, 8, 12, 13)


def line_features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each non-empty line, its length in bytes, and the offsets of each text's lines."""
    s, e, doc = tk.spans(buf, off, _NOT_NEWLINE)
    n = len(s)
    lines = np.r_[0, np.cumsum(tk.counts(doc, len(off) - 1))]
    if not n:
        return np.zeros((0, 16 + 2 * len(_NEIGHBOUR) + 2)), np.zeros(0, np.int64), lines
    size = e - s
    own = [np.log1p(size)]
    run = np.zeros(len(buf) + 1, np.int32)
    for c in _CLASSES:
        np.cumsum(c[buf], out=run[1:])
        own.append((run[e] - run[s]) / size)
    ws, we, wd = tk.spans(buf, off, tk.WORDS)
    h = tk.span_hash(buf, ws, we)
    line = np.searchsorted(s, ws, "right") - 1
    nw = np.bincount(line, minlength=n)
    per = np.maximum(nw, 1)
    own += [np.log1p(nw), np.bincount(line, we - ws, n) / per / 10]
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (wd[1:] == wd[:-1])
    own.append(np.bincount(line, same, n) / per)
    g, whole = tk.grams(h, wd, 3)
    again = np.zeros(len(h))
    if len(g):
        key = tk.mix(g + wd[: len(g)].astype(np.uint64) * tk.U(0xD1342543DE82EF95))
        key = np.where(whole, key, np.arange(len(g), dtype=np.uint64))
        order = np.argsort(key)
        k = key[order]
        twin = np.zeros(len(k), bool)
        twin[1:] = k[1:] == k[:-1]
        twin[:-1] |= twin[1:]
        again[order] = twin
    own.append(np.bincount(line, again, n) / per)
    own += [_STOP[buf[e - 1]] | (buf[e - 1] == 33), _UPPER[buf[s]] | _WIDE[buf[s]]]
    x = np.column_stack(own).astype(np.float64)
    near = x[:, _NEIGHBOUR]
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    full = lines[:-1] < lines[1:]
    first[lines[:-1][full]] = True
    last[lines[1:][full] - 1] = True
    prev, nxt = np.zeros_like(near), np.zeros_like(near)
    prev[1:], nxt[:-1] = near[:-1], near[1:]
    prev[first], nxt[last] = 0, 0
    return np.column_stack([x, prev, nxt, first, last]), size, lines


class Model:
    def __init__(self, crf: LinearChainCRF | None, slope: float = 1.0, bias: float = 0.0):
        self.crf, self.slope, self.bias = crf, slope, bias

    def raw(self, x: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Log-odds of the length-weighted mean marginal; nan without lines."""
        n = len(lines) - 1
        doc = np.repeat(np.arange(n), np.diff(lines))
        good = self.crf.marginals(x, lines)[:, 1]
        total = np.bincount(doc, size, n)
        with np.errstate(divide="ignore", invalid="ignore"):
            m = np.clip(np.bincount(doc, size * good, n) / total, 1e-9, 1 - 1e-9)
            return np.log(m) - np.log1p(-m)

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        x, size, lines = line_features(buf, off)
        if self.crf is None:
            return np.where(np.diff(lines) > 0, 0.5, 0.0)
        z = self.slope * self.raw(x, size, lines) + self.bias
        return np.where(np.isnan(z), 0.0, 1 / (1 + np.exp(-np.clip(np.nan_to_num(z), -500, 500))))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, seed: int = 7, max_lines: int = MAX_TRAIN_LINES, fit_lines: int = MAX_FIT_LINES) -> Model:
    """Learn from labelled rows of which crc32(doc_id as text) mod 3 is not 1.

    The sample is bounded: max_docs ids, the first by a hash; of their rows (2 * max_docs at most,
    where ids repeat) those with max_lines lines or fewer, the first by a hash of id and features,
    as long as they have fit_lines lines together.  No order of the input plays a part."""
    require(docs, "doc_id", "text")
    require(labels, "doc_id", "quality")
    chosen = (
        labels.where("doc_id is not null and quality is not null").where(crc_mod(F.col("doc_id"), 3) != 1)
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_docs)
    )
    # limit() bounds the broadcast side
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").withColumn("id_hash", F.xxhash64("doc_id"))

    def features(batches):
        for b in batches:
            y, ids = b.column("y").to_pylist(), b.column("id_hash").to_pylist()
            for i, j, buf, off in tk.text_blocks(b.column("text")):
                x, size, lines = line_features(buf, off)
                keep = [r for r in range(j - i) if 0 < lines[r + 1] - lines[r] <= max_lines]
                cut = lambda a: [np.ascontiguousarray(a[lines[r] : lines[r + 1]]).tobytes() for r in keep]  # noqa: E731, B023
                yield pa.RecordBatch.from_pydict({"y": pa.array([y[i + r] for r in keep], pa.int32()), "x": pa.array(cut(x.astype(np.float32)), pa.binary()), "size": pa.array(cut(size), pa.binary()), "n": pa.array([lines[r + 1] - lines[r] for r in keep], pa.int64()), "h": pa.array([ids[i + r] for r in keep], pa.int64())})

    key = F.xxhash64("h", "x", F.lit(seed))
    first = rows.mapInArrow(features, "y int, x binary, size binary, n long, h long").withColumn("key", key).orderBy("key", "h").limit(2 * max_docs)
    upto = F.sum("n").over(Window.orderBy("key", "h").rowsBetween(Window.unboundedPreceding, 0))  # 2 * max_docs rows
    got = first.withColumn("upto", upto).where(F.col("upto") <= fit_lines).select("y", "x", "size").toPandas()
    got = got.sort_values(["y", "x"], ignore_index=True)  # the same fit whatever order the rows came in
    if got["y"].nunique() < 2:
        return Model(None)
    sizes = [np.frombuffer(b, np.int64) for b in got["size"]]
    lens = np.array([len(s) for s in sizes])
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(int(lens.sum()), -1).astype(np.float64)
    lines, y = np.r_[0, np.cumsum(lens)], got["y"].to_numpy()
    # A text's label is that of each of its lines; long texts don't outweigh short ones.
    crf = LinearChainCRF(2, l2=1e-4).fit(x, np.repeat(y, lens), lines, weight=1 / np.sqrt(lens))
    model = Model(crf)
    z = model.raw(x, np.concatenate(sizes), lines)
    w = np.zeros(2)
    design = np.column_stack([z, np.ones_like(z)])
    for _ in range(30):  # ridge-stabilised Newton steps
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.eye(2) * 1e-2
        w -= np.linalg.solve(hess, design.T @ (p - y) + 1e-2 * w)
    return Model(crf, float(max(w[0], 1e-3)), float(w[1]))


def quality(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = fit(docs, labels, max_docs)

    def run(batches):
        for b in batches:
            out = [model.scores(buf, off) for _, _, buf, off in tk.text_blocks(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], names=["doc_id", "score"])

    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = d.mapInArrow(run, StructType([docs.schema["doc_id"], StructField("score", DoubleType())]))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_bad(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with the columns of docs."""
    model = fit(docs, labels, max_docs)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            out = [model.scores(buf, off) for _, _, buf, off in tk.text_blocks(b.column(at))]
            yield b.filter(pa.array(np.concatenate(out) >= threshold if out else np.zeros(0, bool)))

    return docs.mapInArrow(run, StructType(docs.schema.fields))
