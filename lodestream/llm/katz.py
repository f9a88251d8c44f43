"""Operator 10: a bigram language model with Katz backoff.

P(w|h) is the Good-Turing discounted count of (h, w) over that of h where the pair was
seen, else alpha(h) P(w); alpha(h) is what the seen pairs leave, over what their words
leave of the unigram distribution, so that P(.|h) sums to one over all words seen and
one unseen word.  P(w) is discounted likewise; what it leaves is the unseen word's.
Counts over K are kept but for RESERVE of one occurrence, so that no history leaves
nothing to back off to.

Words are 64-bit hashes.  A map task packs the pairs of some MAX_TOKENS tokens, sorted
and counted, with the texts that hold them, into one block for each bucket of words;
the bucket of a word so sees all its pairs, hence its count, adds up the parts of each
text's score that these decide, and the parts of each history's sums.  Discounts and
histories are added at the end.  Words with over 1 / (4 buckets) of all tokens (over
1 / HEAVY, where there are many buckets, so HEAVY at most) are counted beforehand and spread over all buckets by pair; pairs that
frequent are counted beforehand too and scored where they are read.

Unigram counts and history weights are written as tables of the shared folder.

Defined results: a null or empty text is the end token alone; rows without doc_id are
scored but not learnt from (held_out null); repeated rows count as they come; other
columns, whatever their names, are not read; very long texts are taken whole;
without training rows every score is that of one unseen word per token."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm import textkernel as tk
from lodestream.llm.blocks import give_back, pack, small, unpack
from lodestream.llm.common import Stored, crc_mod, pieces, require

K, RESERVE = 5, 1 / 1024
#: Words counted beforehand, at most.
HEAVY = 16_384
MAX_TOKENS = 800_000
BUCKET_BYTES = 10 << 20
END, BOS = np.uint64(0x0E0D), np.uint64(0x0B05)
_M = [f"m{r}" for r in range(1, K + 1)]
_N = [f"n{r}" for r in range(1, K + 2)]


def discounts(n: list[int]) -> np.ndarray:
    """d_1..d_K from the counts of counts n_1..n_(K+1). A discount that isn't in (0, 1) gives way
    to keeping all but RESERVE of one occurrence; if none is, d_1 is 1/2."""
    d = 1 - RESERVE / np.arange(1, K + 1)
    plain = d.copy()
    common = (K + 1) * n[K] / n[0] if n[0] else 1.0
    for r in range(1, K + 1):
        if n[r - 1] and common < 1:
            x = ((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common)
            if 0 < x < plain[r - 1]:
                d[r - 1] = x
    if (d == plain).all():
        d[0] = 0.5
    return d


class Unigrams:
    """Numbers of the whole training part, and the counts of its heaviest words."""

    def __init__(self, total: int, distinct: int, n: list[int], big: int, n_big: int, texts: int):
        self.total, self.distinct, self.texts = total, distinct, texts
        self.d = discounts(n)
        seen = sum(n[r - 1] * r * self.d[r - 1] for r in range(1, K + 1)) + big - RESERVE * n_big
        self.unseen = 1 - seen / total if total else 1.0

    def log_p(self, c: np.ndarray) -> np.ndarray:
        kept = np.where(c > K, c - RESERVE, c * np.r_[1.0, self.d][np.minimum(c, K)])
        with np.errstate(divide="ignore"):
            return np.log10(np.where(c > 0, kept / max(self.total, 1), self.unseen))

    def log_base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.total + self.distinct + 1))


def _tokens(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token, history and text of every token, ends included."""
    c = tk.counts(doc, n)
    ends = np.cumsum(c + 1) - 1
    w = np.empty(len(h) + n, np.uint64)
    w[np.arange(len(h)) + doc] = h
    w[ends] = END
    hist = np.empty_like(w)
    hist[1:] = w[:-1]
    hist[np.r_[0, ends[:-1] + 1]] = BOS
    return w, hist, np.repeat(np.arange(n, dtype=np.int64), c + 1)


def _streams(batches):
    """Rows of a partition in runs of some MAX_TOKENS tokens: (ids, held, w, h, doc)."""
    ids, held, parts, base, size = [], [], [], 0, 0

    def flush():
        cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
        parts.clear()
        give_back()
        return ids, np.array(held, np.int8), *cols

    for b in batches:
        bi, bh = b.column(0).to_pylist(), b.column(1).to_pylist()
        for i, j, buf, off in tk.text_blocks(b.column(2), 1 << 20):
            h, doc = tk.words(buf, off)
            w, hist, d = _tokens(h, doc, j - i)
            parts.append((w, hist, d + base))
            ids += bi[i:j]
            held += [2 if x is None else int(x) for x in bh[i:j]]
            base += j - i
            size += len(w)
            if size >= MAX_TOKENS:
                yield flush()
                ids, held, parts, base, size = [], [], [], 0, 0
    if parts:
        yield flush()


def _runs(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _count(share: float):
    """Training counts of words (h null), and of the pairs with half of `share` of a run's tokens."""

    def run(batches):
        for _, held, w, h, d in _streams(batches):
            ok = held[d] == 0
            if not ok.any():
                continue
            u, c = np.unique(w[ok], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.nulls(len(u), pa.int64()), pa.array(c.astype(np.int64))], names=["w", "h", "c"])
            least = max(1.0, share / 2 * len(w))
            hot = u[c >= least]  # both words of such a pair are as frequent
            sub = ok & np.isin(w, hot)
            x, y = w[sub], h[sub]
            o = np.lexsort((y, x))
            x, y = x[o], y[o]
            at = _runs(x, y)
            n = np.diff(np.r_[at, len(x)])
            at, n = at[n >= least], n[n >= least]
            yield pa.RecordBatch.from_arrays([pa.array(x[at].view(np.int64)), pa.array(y[at].view(np.int64)), pa.array(n.astype(np.int64))], names=["w", "h", "c"])

    return run


def _pair_key(w: np.ndarray, h: np.ndarray) -> np.ndarray:
    return tk.mix(w * tk.U(0x9E3779B97F4A7C15) + h)


def _find(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each x among sorted_keys, or -1."""
    if not len(sorted_keys):
        return np.full(len(x), -1)
    i = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return np.where(sorted_keys[i] == x, i, -1)


def _count_pairs(keys: np.ndarray):
    def run(batches):
        total = np.zeros(len(keys), np.int64)
        for _, held, w, h, d in _streams(batches):
            i = _find(keys, _pair_key(w, h))
            total += np.bincount(i[(i >= 0) & (held[d] == 0)], minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(keys), dtype=np.int64)), pa.array(total)], names=["i", "c"])

    return run


def _per_doc(doc: np.ndarray, n: int, cols: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of each column by text, of the texts that occur."""
    idx = np.flatnonzero(np.bincount(doc, minlength=n))
    return [idx.astype(np.uint32), *[np.bincount(doc, c, n)[idx] for c in cols]]


def _seen(r: np.ndarray) -> np.ndarray:
    """log10 of a seen pair's count; discounts of counts up to K come later, from the m columns."""
    return np.log10(np.where(r > K, r - RESERVE, np.maximum(r, 1)))


def _blocks(nb: int, uni: Unigrams, hw: np.ndarray, hc: np.ndarray, pk: np.ndarray, pc: np.ndarray):
    """Maps texts to (bucket, batch, block); hw, hc: heavy words and counts; pk, pc: heavy pairs."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for ids, held, w, h, d in _streams(batches):
            batch, n = (part << 24) | seq, len(ids)
            seq += 1
            # what the frequent words and pairs decide is decided here
            iw, ip = _find(hw, w), _find(pk, _pair_key(w, h))
            fw, fp = iw >= 0, ip >= 0
            c, r = hc[iw[fw]], pc[ip[fp]]
            of = lambda at, x: np.bincount(d[at], x, n)
            s = of(fp, np.where(r > 0, _seen(r), uni.log_p(hc[iw[fp]]))) - of(fw, np.where((c > 0) & (w[fw] != END), np.log10(np.maximum(c, 1)), 0))
            sums = [of(fw, uni.log_base(c)), of(fw, c > 0), s, *[of(fp, r == k + 1) for k in range(K)]]
            del iw, ip, fw
            idx = np.array([0 if x is None else x for x in ids], np.int64)
            none = np.array([x is None for x in ids], np.uint8)
            table = [idx.view(np.uint64), none, held.astype(np.uint8), tk.counts(d, n).astype(np.uint64)]
            block = pack([*table, np.arange(n, dtype=np.uint32), *sums])
            out = [(batch % nb, batch, True, block)]
            del sums, table
            o = np.lexsort((h, w)) if not fp.any() else (k := np.flatnonzero(~fp))[np.lexsort((h[k], w[k]))]
            x, y, e = w[o], h[o], d[o] * 4 + held[d[o]]
            del w, h, d, o, fp
            entry = _runs(x, y, e)
            cnt, e = np.diff(np.r_[entry, len(x)]), e[entry]
            pair = _runs(x[entry], y[entry])
            gx, gy, gn = x[entry][pair], y[entry][pair], np.diff(np.r_[pair, len(entry)])
            spread = np.where(_find(hw, gx) >= 0, _pair_key(gx, gy), tk.mix(gx))
            bucket = (spread % tk.U(nb)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(nb + 1))
            for b in np.flatnonzero(cut[1:] > cut[:-1]):
                g = order[cut[b] : cut[b + 1]]
                k = np.repeat(pair[g] - (np.cumsum(gn[g]) - gn[g]), gn[g]) + np.arange(gn[g].sum())
                wx = _runs(gx[g])
                out.append((int(b), batch, False, pack([np.array([n], np.uint64), gx[g][wx], small(np.diff(np.r_[wx, len(g)])), gy[g], small(gn[g]), small(e[k]), small(cnt[k])])))
            for lo in range(0, len(out), 64):
                z = list(zip(*out[lo : lo + 64], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(z[0], pa.int32()), pa.array(z[1], pa.int64()), pa.array(z[2], pa.bool_()), pa.array(z[3], pa.binary())], names=["bucket", "batch", "whole", "block"])

    return run


_OUT = f"kind string, batch long, block binary, h long, doc int, n long, big long, n_big long, {', '.join(f'{c} long' for c in _N)}, q double"
_OUT_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def _emit(rows: int, /, **cols) -> pa.RecordBatch:
    types = {"kind": pa.string(), "block": pa.binary(), "doc": pa.int32(), "q": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array(cols[c], types.get(c, pa.int64())) if c in cols else pa.nulls(rows, types.get(c, pa.int64())) for c in _OUT_NAMES], names=_OUT_NAMES)


def _history_rows(h: np.ndarray, r: np.ndarray, q: np.ndarray):
    o = np.argsort(h, kind="stable")
    h, r, q = h[o], r[o], q[o]
    at = _runs(h)
    if not len(h):
        return
    cols = {c: np.add.reduceat((r == k + 1).astype(np.int64), at) for k, c in enumerate(_N)}
    yield _emit(len(at), kind=["h"] * len(at), h=h[at].view(np.int64), big=np.add.reduceat(np.where(r > K, r, 0), at), n_big=np.add.reduceat((r > K).astype(np.int64), at), q=np.add.reduceat(q, at), **cols)


def _bucket(uni: Unigrams, hw: np.ndarray, hc: np.ndarray):
    """One bucket's blocks: parts of the texts' scores, of the histories' sums, and pairs to back off."""

    def run(table: pa.Table) -> pa.Table:
        out, got = [], []
        for batch, whole, block in zip(table["batch"].to_pylist(), table["whole"].to_pylist(), table["block"].to_pylist(), strict=True):
            if whole:
                out.append(_emit(1, kind=["d"], batch=[batch], block=[b"\x01" + block]))
            else:
                n, ux, un, gy, gn, e, cnt = unpack(block)
                got.append((batch, int(n[0]), np.repeat(ux, un), gy, gn, e.astype(np.int64), cnt.astype(np.int64)))
        if got:
            size = [len(g[3]) for g in got]
            x, y = np.concatenate([g[2] for g in got]), np.concatenate([g[3] for g in got])
            local = np.concatenate([np.bincount(np.repeat(np.arange(len(g[4])), g[4]), g[6] * (g[5] % 4 == 0), len(g[4])) for g in got]).astype(np.int64)
            o = np.lexsort((y, x))
            at = _runs(x[o], y[o])
            pair = np.empty(len(x), np.int64)
            pair[o] = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(x)]))
            r = np.bincount(pair, local, len(at)).astype(np.int64)
            px, py = x[o][at], y[o][at]
            first = _runs(px)
            cw = np.repeat(np.add.reduceat(r, first), np.diff(np.r_[first, len(px)]))
            heavy = _find(hw, px)
            is_heavy = heavy >= 0
            if is_heavy.any():
                cw = np.where(is_heavy, hc[heavy], cw)
            lp = uni.log_p(cw)
            out += list(_history_rows(py[r > 0], r[r > 0], 10 ** lp[r > 0]))
            # by pair: what each occurrence adds
            s = np.where(r > 0, _seen(r), lp) - np.where(~is_heavy & (cw > 0) & (px != END), np.log10(np.maximum(cw, 1)), 0)
            base, known = np.where(is_heavy, 0, uni.log_base(cw)), np.where(is_heavy, 0, cw > 0)
            lo = 0
            for (batch, n, _, gy, gn, e, cnt), m in zip(got, size, strict=True):
                p = np.repeat(pair[lo : lo + m], gn)
                lo += m
                doc, rp = e // 4, r[p]
                cols = [base[p] * cnt, known[p] * cnt, s[p] * cnt, *[(rp == k + 1) * cnt for k in range(K)]]
                out.append(_emit(1, kind=["d"], batch=[batch], block=[b"\x00" + pack(_per_doc(doc, n, cols))]))
                lost = np.flatnonzero(rp == 0)
                if len(lost):
                    out.append(_emit(len(lost), kind=["x"] * len(lost), batch=np.full(len(lost), batch), doc=doc[lost].astype(np.int32), h=np.repeat(gy, gn)[lost].view(np.int64), n=cnt[lost]))
        del got
        give_back()
        return pa.Table.from_batches(out, schema=_emit(0).schema)

    return run


_DOC = f"batch long, doc int, doc_id long, held int, n_tokens long, n_known long, base_score double, s double, {', '.join(f'{c} long' for c in _M)}"


def _gather(table: pa.Table) -> pa.Table:
    """All blocks of one batch of texts: a row for each text."""
    blocks = table["block"].to_pylist()
    whole = [unpack(b[1:]) for b in blocks if b[:1] == b"\x01"][0]
    ids, none, held, tokens, *first = whole
    n = len(ids)
    sums = np.zeros((3 + K, n))
    for idx, *cols in [first, *[unpack(b[1:]) for b in blocks if b[:1] == b"\x00"]]:
        sums[:, idx] += np.array(cols)
    num = lambda a: pa.array(np.rint(a).astype(np.int64))
    ids = pa.array(ids.view(np.int64), mask=none.astype(bool))
    names = [x.split()[0] for x in _DOC.split(", ")]
    return pa.Table.from_arrays([pa.array(np.full(n, table["batch"][0].as_py())), pa.array(np.arange(n, dtype=np.int32)), ids, pa.array(held.astype(np.int32)), pa.array(tokens.astype(np.int64)), num(sums[1]), pa.array(sums[0]), pa.array(sums[2]), *[num(sums[3 + k]) for k in range(K)]], names=names)


def katz_scores(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    require(docs, "doc_id", "text")
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(F.col("doc_id"), modulus) == held).alias("held"), F.col("text").cast("string").alias("text"))
    nb = pieces(docs, BUCKET_BYTES)
    share = max(1 / (4 * nb), 1 / HEAVY)

    counted = Stored(d.mapInArrow(_count(share), "w long, h long, c long").groupBy("h", "w").agg(F.sum("c").alias("c")), "katz-unigrams")
    words = counted.df.where("h is null")
    sums = [F.sum("c"), F.count("*"), *[F.count_if(F.col("c") == r) for r in range(1, K + 2)], F.sum(F.when(F.col("c") > K, F.col("c"))), F.count_if(F.col("c") > K), F.sum(F.when(F.col("w") == int(END), F.col("c")))]
    total, distinct, *n, big, n_big, texts = (x or 0 for x in words.agg(*sums).first())
    uni = Unigrams(total, distinct, n, big, n_big, texts)
    # at most 1 / share words, and twice as many pairs
    heavy = sorted((np.uint64(w & (2**64 - 1)), c) for w, c in words.where(F.col("c") >= share * total).select("w", "c").collect()) if total else []
    hw, hc = np.array([w for w, _ in heavy], np.uint64), np.array([c for _, c in heavy], np.int64)
    cand = counted.df.where("h is not null").where(F.col("c") >= share / 2 * total).select("w", "h").collect() if total else []
    counted.drop()
    # a pair is heavy only where its word is, so that its word's count is known too
    pw, ph = (np.array([x[i] for x in cand], np.int64).view(np.uint64) for i in (0, 1))
    ok = _find(hw, pw) >= 0
    pw, ph = pw[ok], ph[ok]
    keys = _pair_key(pw, ph)
    o = np.argsort(keys)
    pk, pw, ph, pc = keys[o], pw[o], ph[o], np.zeros(len(keys), np.int64)
    if len(pk):
        for i, c in d.mapInArrow(_count_pairs(pk), "i long, c long").groupBy("i").agg(F.sum("c")).collect():
            pc[i] = c
    blocks = d.mapInArrow(_blocks(nb, uni, hw, hc, pk, pc), "bucket int, batch long, whole boolean, block binary")
    parts = Stored(blocks.repartitionById(nb, "bucket").groupBy("bucket").applyInArrow(_bucket(uni, hw, hc), _OUT), "katz-parts")

    hist = parts.df.where("kind = 'h'").select("h", "big", "n_big", *_N, "q")
    if len(pk):
        lp = uni.log_p(hc[_find(hw, pw)])
        rows = [tuple(r) for b in _history_rows(ph[pc > 0], pc[pc > 0], 10 ** lp[pc > 0]) for r in zip(*[b.column(c).to_pylist() for c in hist.columns], strict=True)]
        hist = hist.union(spark.createDataFrame(rows, hist.schema)) if rows else hist
    hist = Stored(hist.groupBy("h").agg(*[F.sum(c).alias(c) for c in hist.columns[1:]]), "katz-histories")
    dd = discounts([x or 0 for x in hist.df.agg(*[F.sum(c) for c in _N]).first()])
    low = sum((F.col(_N[r - 1]) * r for r in range(1, K + 1)), F.lit(0))
    kept = sum((F.col(_N[r - 1]) * (r * float(dd[r - 1])) for r in range(1, K + 1)), F.lit(0.0)) + F.col("big") - F.col("n_big") * RESERVE
    count = F.col("big") + low
    alpha = F.greatest(1 - kept / count, F.lit(1e-300)) / F.greatest(1 - F.col("q"), F.lit(1e-12))
    # scores took every seen history's count off each pair; where the pair is unseen it is given back
    back = hist.df.select("h", (F.log10(alpha) + F.log10(count)).alias("back"))
    lost = parts.df.where("kind = 'x'").join(back, "h").groupBy("batch", "doc").agg(F.sum(F.col("n") * F.col("back")).alias("back"))
    texts_ = parts.df.where("kind = 'd'").select("batch", "block").groupBy("batch").applyInArrow(_gather, _DOC)
    start = float(np.log10(texts)) if texts else 0.0
    score = F.col("s") - F.lit(start) + F.coalesce("back", F.lit(0.0)) + sum((F.col(_M[r]) * float(np.log10(dd[r])) for r in range(K)), F.lit(0.0))
    out = texts_.join(lost, ["batch", "doc"], "left")
    return out.select(
        "doc_id", F.when(F.col("held") < 2, F.col("held") == 1).alias("held_out"), "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", score.alias("score")
    )
