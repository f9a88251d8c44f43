"""Text operators against brute force, and their defined results at the edges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import decontam, katz, mixing, neardup, quality, suffixdedup
from lodestream.llm import textkernel as tk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, u string, key string"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return WORD.findall(lower(t))


def corpus(n=60, seed=5):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 7))) for _ in range(200)]
    text = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage = text(30)
    out = []
    for i in range(n):
        t = "\n".join(text(r.randint(1, 25)) for _ in range(r.randint(1, 5)))
        if i % 7 == 3:
            t += "\n" + passage + " " + text(3)
        if i % 9 == 5 and out:
            t = r.choice(out)
        if i % 11 == 6 and out:
            w = (out[-1] or "x").split(" ")
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        out.append(t)
    out[10], out[11], out[12], out[13], out[14] = None, "", " \n\t ", "single", "Single"
    out[15] = text(9000)  # a long one
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(100 + i, t, None if i % 13 == 0 else "en", None if i % 17 == 0 else f"src{i % 4}", None, "x", "k") for i, t in enumerate(corpus())]
    rows += [rows[20], rows[20], (None, rows[21][1], None, None, None, None, None)]  # repeated rows, a null id
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_word_hashes_follow_words():
    import pyarrow as pa

    texts = corpus()
    buf, off = tk.column(pa.array(texts))
    h, d = tk.words(buf, off)
    flat = [(i, w) for i, t in enumerate(texts) for w in words(t)]
    assert d.tolist() == [i for i, _ in flat]
    by = defaultdict(set)
    for (_, w), x in zip(flat, h.tolist(), strict=True):
        by[w].add(x)
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)
    sliced = tk.words(*tk.column(pa.array(texts).slice(7, 20)))[0]
    assert sliced.tolist() == [x for (i, _), x in zip(flat, h.tolist(), strict=True) if 7 <= i < 27]


def test_word_hashes_of_thue_morse_words(spark):
    """Words that a polynomial hash cannot tell apart."""
    import pyarrow as pa

    t = "a"
    for _ in range(12):
        t += t.translate(str.maketrans("ab", "ba"))
    for n in (512, 1024, 2048, 4096):
        x, y = t[:n], t[:n].translate(str.maketrans("ab", "ba"))
        h, _ = tk.words(*tk.column(pa.array([x, y, x + "c"])))
        assert len(set(h.tolist())) == 3
    rows = [(1, t[:2048]), (2, t[:2048].translate(str.maketrans("ab", "ba"))), (7, "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(d, k=2).collect()} == {1: 1, 2: 2, 7: 7}
    assert {r.doc_id: r.n_known for r in katz.katz_scores(d, modulus=2, held=9).collect()} == {1: 2, 2: 2, 7: 2}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_match_brute_force(docs, k):
    rows = [r for r in docs.collect() if r.doc_id is not None]
    sets = {}
    for r in rows:
        w = words(r.text)
        sets[r.doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    got = neardup.near_duplicates(docs, k).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    kept = neardup.drop_near_duplicates(docs, k)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({find(i) for i in sets}) and ids.count(None) == 1


@pytest.mark.parametrize(("together", "block"), [(0, 5), (8, 5), (0, 512)])
def test_ends_of_the_comparison_agree(spark, monkeypatch, together, block):
    """Groups of bands compared together and band by band, in blocks of any size, with hubs that find little."""
    r = random.Random(5)
    rows, want = [], {}
    for g in range(4):  # similar but unlinked families, whose members come in linked pairs
        base = [f"g{g}w{i}" for i in range(100)]
        for m in range(12):
            w = list(base)
            for j in r.sample(range(100), 12):
                w[j] = f"v{g}_{m}_{j}"
            for copy in range(2):
                rows.append((g * 100 + 2 * m + copy, " ".join([*w[:-1], f"end{copy}"])))
    monkeypatch.setattr(neardup, "TOGETHER", together)
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "HUB_ROUNDS", 1)
    sets = {i: {tuple(t.split()[j : j + 2]) for j in range(99)} for i, t in rows}
    up = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = sorted((up[a], up[b]))
                up = {i: ra if x == rb else x for i, x in up.items()}
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == up and len(set(up.values())) < len(up)


def test_near_duplicates_at_the_edges(spark):
    long = " ".join(f"w{i % 5000}x{i}" for i in range(60_000))
    rows = [(1, "a b c d e f g h", "k1", 1), (1, "one two three four five six seven", "k2", 2), (2, "one two three four five six seven", "k3", 3), (3, long, "k4", 4), (4, long + " end", "k5", 5), (5, None, "k6", 6), (5, "", "k7", 7), (6, "a b c d e f g h", "k8", 8), (6, "a b c d e f g h", "k9", 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, cls string, kept long")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(d, 2).collect())
    assert got == [(1, 6, 1, True), (1, 7, 1, True), (2, 6, 1, False), (3, 59_999, 3, True), (4, 60_000, 3, False), (5, 0, 5, True), (5, 0, 5, True), (6, 7, 1, False), (6, 7, 1, False)]
    left = neardup.drop_near_duplicates(d, 2)
    assert left.columns == d.columns and sorted(r.cls for r in left.collect() if r.doc_id != 5) == ["k1", "k2", "k4"]  # both texts of id 1 stay


def test_short_texts_that_share_no_band_are_linked(spark):
    alone = [81, 82, 149, 446, 449, 968, 1228, 1260]  # four of five shingles alike, and no band of the registers
    rows = []
    for n, i in enumerate(alone):
        w = [f"w{i}x{j}" for j in range(6)]
        rows += [(2 * n, " ".join(w)), (2 * n + 1, " ".join(w[:5]))]
    rows += [(100 + n, f"w81x0 w81x1 z{n} y{n} v{n} u{n}") for n in range(30)]  # one common shingle links nothing
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {i: i - i % 2 if i < 100 else i for i, _ in rows}


def test_a_star_of_near_copies_is_one_component(spark):
    """Copies that are near their base but not near each other, the base's id not the smallest."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = [(50, " ".join(base))]
    for i in range(40):
        w = list(base)
        for j in r.sample(range(120), 6):
            w[j] = f"x{i}_{j}"
        rows.append((i if i < 20 else 60 + i, " ".join(w)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    sets = {i: set(zip(t.split(), t.split()[1:])) for i, t in rows}
    linked = [i for i in sets if 100 * len(sets[i] & sets[50]) >= 80 * len(sets[i] | sets[50])]
    assert len(linked) > 20
    comp = {r.doc_id: r.component_id for r in got}
    assert {comp[i] for i in linked} == {min(linked)}


def test_repeated_bytes_match_brute_force(docs):
    rows = [r for r in docs.collect() if r.doc_id is not None]
    first = {}
    for r in rows:
        b = (r.text or "").encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], r.doc_id), r.doc_id)
    want = {}
    for r in rows:
        b = (r.text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < r.doc_id:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        want[r.doc_id] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    got = suffixdedup.repeated_bytes(docs).collect()
    assert len(got) == docs.count() and any(w[1] for w in want.values())
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
    out = suffixdedup.drop_repeats(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        assert r.doc_id is None or want[r.doc_id][1] or r.text == texts[r.doc_id]


def test_head_classes_over_small_alphabet():
    """Long ties everywhere: classes are those of equal heads within a bucket."""
    rng = np.random.default_rng(2)
    text = rng.choice(np.frombuffer(b"ab", np.uint8), 3000, p=[0.97, 0.03])
    at = np.sort(rng.choice(2900, 1500, replace=False))
    bucket = rng.integers(0, 3, len(at))
    cls = suffixdedup.head_classes(text, at, bucket)
    by = defaultdict(set)
    for i, p in enumerate(at):
        by[(int(bucket[i]), text[p : p + 50].tobytes())].add(int(cls[i]))
    assert all(len(v) == 1 for v in by.values())
    assert len({min(v) for v in by.values()}) == len(by)


def test_katz_matches_brute_force(docs):
    rows = [r for r in docs.collect() if r.doc_id is not None]
    train = [["</s>"] if r.text is None else [*words(r.text), "</s>"] for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    u, b, hist = Counter(), Counter(), Counter()
    for w in train:
        u.update(w)
        h = ["<s>", *w[:-1]]
        b.update(zip(h, w, strict=True))
        hist.update(h)
    total, d1 = sum(u.values()), katz.discounts([Counter(u.values())[r] for r in range(1, katz.K + 2)])
    d2 = katz.discounts([Counter(b.values())[r] for r in range(1, katz.K + 2)])
    star = lambda c, d: c - katz.RESERVE if c > katz.K else c * d[c - 1]
    unseen = 1 - sum(star(c, d1) for c in u.values()) / total
    p1 = lambda w: star(u[w], d1) / total if u[w] else unseen
    kept, cover = defaultdict(float), defaultdict(float)
    for (h, w), c in b.items():
        kept[h] += star(c, d2)
        cover[h] += p1(w)
    alpha = {h: (1 - kept[h] / hist[h]) / (1 - cover[h]) for h in kept}
    p = lambda h, w: star(b[h, w], d2) / hist[h] if b[h, w] else alpha.get(h, 1) * p1(w)
    for h in list(hist)[:20]:
        assert abs(sum(p(h, w) for w in u) + p(h, "never seen") - 1) < 1e-9
    got = {r.doc_id: r for r in katz.katz_scores(docs).collect()}
    for r in rows:
        w, g = [*words(r.text), "</s>"], got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and g.train_tokens == total
        assert (g.n_tokens, g.n_known) == (len(w), sum(u[x] > 0 for x in w))
        assert math.isclose(g.score, sum(math.log10(p(h, x)) for h, x in zip(["<s>", *w[:-1]], w, strict=True)), rel_tol=1e-9)
        assert math.isclose(g.base_score, sum(math.log10((u[x] + 1) / (total + len(u) + 1)) for x in w), rel_tol=1e-9)
    assert got[None].held_out is None


def test_katz_with_heavy_words_and_pairs(spark):
    """One pair that holds over a third of all tokens is counted beforehand; scores don't change."""
    rows = [(i, "hot pair " * 40 + f"w{i % 7} v{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in katz.katz_scores(df).collect()}
    assert len(got) == 60 and all(math.isfinite(x) and x < 0 for x in got.values())
    plain = katz.pieces
    try:
        katz.pieces = lambda *a: 4000  # with that many buckets another set is heavy
        again = {r.doc_id: r.score for r in katz.katz_scores(df.repartition(3)).collect()}
    finally:
        katz.pieces = plain
    assert all(math.isclose(got[i], again[i], rel_tol=1e-9) for i in got)


def test_decontamination_matches_brute_force(spark, docs):
    r = random.Random(8)
    item = " ".join(f"Bench{r.randint(0, 999)}" for _ in range(30))
    near = item.split()
    near[29] = "other"
    far = item.split()
    far[3], far[9], far[15], far[21] = "a", "b", "c", "d"
    rows = [(1, f"before, {item.upper()}! after"), (2, "x " * 50 + " ".join(near)), (3, " ".join(far)), (4, None), (5, ""), (6, "tiny item"), (7, item), (7, item), (None, item)]
    bench = spark.createDataFrame([(10, item), (11, "tiny item"), (12, None), (13, " "), (10, item)], "item_id long, text string")
    got = decontam.matches(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert Counter((x.doc_id, x.item_id) for x in got) == Counter({(1, 10): 2, (2, 10): 2, (6, 11): 1, (7, 10): 4, (None, 10): 2})
    assert {x.first_word for x in got if x.doc_id == 1} == {1} and all(x.similarity >= 0.8 for x in got)
    kept = decontam.drop_contaminated(docs.unionByName(spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in rows], DOCS)), bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() + 3  # 3, 4 and 5
    assert decontam.matches(docs, bench.limit(0)).count() == 0
    one_by_one = decontam.matches(spark.createDataFrame(rows, "doc_id long, text string"), bench, chunk=1)
    assert one_by_one.count() == len(got)


@pytest.mark.parametrize("n", [50, 6000])
def test_multi_index_finds_all_within_radius(n):
    """By passing over few keys, and by flipping bits where keys are many."""
    rng = np.random.default_rng(4)
    of = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
    probes = of[:50].copy()
    for i in range(50):
        for f in rng.choice(64, decontam.RADIUS, replace=False):
            probes[i] ^= np.uint64(1) << np.uint64(f)
    index = decontam.Index(of, np.arange(n))
    assert (len(index.keys[0]) > len(decontam._FLIPS)) == (n == 6000)
    got = list(zip(*(x.tolist() for x in index.near(probes)), strict=True))
    d = np.bitwise_count(probes[:, None] ^ of[None, :])
    assert sorted(got) == sorted(zip(*(x.tolist() for x in np.nonzero(d <= decontam.RADIUS)), strict=True)) and {(i, i) for i in range(50)} <= set(got)
    close = np.zeros((50, n), bool)
    for b in range(decontam.BLOCKS):
        close |= np.bitwise_count((probes.view(np.uint16).reshape(-1, 4)[:, b, None] ^ of.view(np.uint16).reshape(-1, 4)[None, :, b])) <= decontam.FLIP
    assert close.mean() < 0.2  # what the index lets through of random pairs


def test_decontamination_recall_by_brute_force(spark):
    """Items changed in some words, so that the best window lies about the threshold: all that reach it are found."""
    r = random.Random(12)
    vocab = [f"word{i}" for i in range(3000)]
    items = [[r.choice(vocab) for _ in range(r.choice([40, 60]))] for _ in range(120)]
    docs_, want = [], set()
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    for d in range(240):
        i = d % 120
        w = list(items[i])
        at = r.randrange(3, len(w) - 3)
        w[at] = "changed"
        if d >= 120:
            w[0] = "another"
        words_ = [r.choice(vocab) for _ in range(50)] + w + [r.choice(vocab) for _ in range(30)]
        docs_.append((d, " ".join(words_)))
        for k, it in enumerate(items):
            g = grams(it)
            for s in range(len(words_) - len(it) + 1):
                x = grams(words_[s : s + len(it)])
                if sum((g & x).values()) >= 0.8 * sum((g | x).values()):
                    want.add((d, k))
    got = decontam.matches(spark.createDataFrame(docs_, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")).collect()
    found = {(x.doc_id, x.item_id) for x in got}
    assert found <= want and len(want) > 100 and len(found) >= 0.99 * len(want), (len(found), len(want))


def test_decontamination_edges(spark):
    item = " ".join(f"b{i}" for i in range(25))
    rows = [(1, "x " * 400_000 + item, "k"), (2, item + " . " + item, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, item_id string")  # a clashing name
    got = {x.doc_id: x for x in decontam.matches(d, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()}
    assert got[1].first_word == 400_000 and got[2].first_word == 0 and got[2].n_words == 25
    assert decontam.drop_contaminated(d, spark.createDataFrame([(5, "no such words at all here")], "item_id long, text string")).columns == d.columns


def test_quality_learns_and_ignores_held_out_labels(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 != 0
        lines = [" ".join("".join(r.choice("etaoinsh") for _ in range(r.randint(2, 8))) for _ in range(12)).capitalize() + "." for _ in range(4)]
        rows.append((i, "\n".join(lines if good else [x.upper().replace(" ", "!! ") for x in lines])))
        labels.append((i, int(good), 0))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.quality(df, lab).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all(got[i].held_out == (i in held) for i in got)
    assert sum(got[i].predicted == int(i % 3 != 0) for i in held) >= 0.98 * len(held)
    lies = spark.createDataFrame([(i, 1 - q if i in held else q, t) for i, q, t in labels], lab.schema)
    again = {x.doc_id: x.score for x in quality.quality(df, lies).collect()}
    assert all(again[i] == got[i].score for i in got)


def test_quality_edges(spark, docs, empty):
    lab = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    got = quality.quality(docs, lab).collect()
    assert len(got) == docs.count()
    assert all(x.score == (0.5 if WORD.search(t or "") or (t or "").strip("\n") else 0.0) for x, t in ((x, {r.doc_id: r.text for r in docs.collect()}[x.doc_id]) for x in got))
    assert quality.reject_bad(docs, lab).columns == docs.columns
    assert quality.quality(empty, lab).count() == 0


def test_mixing_shares_and_prefixes(spark):
    rows = [(i, "w " * (1 + i % 5), "en" if i % 2 else "de", f"src{i % 3}", None, None, None) for i in range(300)]
    df = spark.createDataFrame([*rows, (900, None, "en", "src0", None, None, None), (901, "one two", None, None, None, None, None)], DOCS)
    from pyspark.sql import functions as F

    got = mixing.mix(df, F.col("source"), {"src0": 1, "src1": 1, "src2": 2}, {"en": 3, "de": 1}, {}, fraction=0.9, max_epochs=2).collect()
    total = sum(len((r[1] or "").split()) for r in rows) + 2
    drawn = sum(r.mix_tokens * r.mix_copies for r in got)
    assert drawn <= 0.9 * total and drawn > 0.9 * total - 6 * 8  # each leaf stops short by less than a text, and rounding
    by = Counter()
    for r in got:
        by[r.source] += r.mix_tokens * r.mix_copies
    assert by["src2"] > 1.5 * by["src0"] and 900 not in {r.doc_id for r in got}
    assert {r.doc_id: r.mix_copies for r in got} == {r.doc_id: r.mix_copies for r in mixing.mix(df.repartition(7), F.col("source"), {"src0": 1, "src1": 1, "src2": 2}, {"en": 3, "de": 1}, {}, fraction=0.9, max_epochs=2).collect()}


def test_mixing_edges(spark, monkeypatch):
    """Clashing names, a very long text, nulls and repeated rows; leaves joined over salts give the same."""
    rows = [(i % 50 if i % 9 else None, "w " * (i % 13), None if i % 5 == 0 else "en", f"s{i % 3}", i, "t", "x") for i in range(120)] + [(1000, "word " * 200_000, "de", "s0", 0, "t", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mix_rest long, mix_tokens string, mix_salt string")
    args = {"domain": F.lit("d"), "domain_weights": {}, "lang_weights": {"en": 2}, "source_weights": {}, "fraction": 0.6}
    got = mixing.mix(d, **args)
    assert got.columns == ["doc_id", "text", "lang", "source", "mix_rest", "mix_salt", "mix_domain", "mix_tokens", "mix_copies"]
    first = sorted(map(str, got.collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST_LEAVES", 0)
    assert sorted(map(str, mixing.mix(d, **args).collect())) == first and first
    again = mixing.mix(d.withColumn("n", mixing.token_count("text")).drop("text"), **args, tokens=F.col("n"))
    assert sorted(str((r.doc_id, r.mix_rest, r.mix_copies)) for r in again.collect()) == sorted(str((r.doc_id, r.mix_rest, r.mix_copies)) for r in got.collect())


def test_mixing_moves_shortages_to_siblings_first(spark):
    from pyspark.sql import functions as F

    # domain a: source x has 10 tokens, y has 1000; domain b has 1000. x's shortage stays in a.
    rows = [(i, "t", "en", "x", None, "a", None) for i in range(10)] + [(100 + i, "t", "en", "y", None, "a", None) for i in range(1000)] + [(2000 + i, "t", "en", "z", None, "b", None) for i in range(1000)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), F.col("u"), {}, {}, {}, fraction=0.5, max_epochs=1).collect()
    by = Counter(r.source for r in got)
    assert by["x"] == 10 and by["x"] + by["y"] == by["z"] == 1005 * 2010 // 4020


def test_empty_tables(spark, empty):
    from pyspark.sql import functions as F

    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert neardup.near_duplicates(empty).count() == 0
    assert suffixdedup.repeated_bytes(empty).count() == 0 and suffixdedup.drop_repeats(empty).count() == 0
    assert katz.katz_scores(empty).count() == 0
    assert decontam.matches(empty, bench).count() == 0
    assert mixing.mix(empty, F.col("source"), {}, {}, {}).count() == 0


def test_quality_is_the_length_weighted_mean_of_marginals_by_enumeration():
    """Whole texts against sums over all labellings of their lines."""
    import itertools

    import pyarrow as pa

    from lodestream.llm.crf import LinearChainCRF

    texts = ["One line here.\nAnother, longer line is here too.\n\nbuy buy buy", "alone", "a\nb\nc\nd", ""]
    x, size, lines = quality.line_features(*tk.column(pa.array(texts)))
    rng = np.random.default_rng(1)
    crf = LinearChainCRF(2)
    crf.mean, crf.scale, crf.w, crf.t = x.mean(0), x.std(0) + 1e-6, rng.normal(size=(x.shape[1] + 1, 2)) / 4, rng.normal(size=(2, 2))
    raw, e = quality.Model(crf).raw(x, size, lines), crf.scores(x)
    for d, (a, b) in enumerate(zip(lines[:-1], lines[1:], strict=True)):
        if a == b:
            assert np.isnan(raw[d])
            continue
        paths = list(itertools.product((0, 1), repeat=int(b - a)))
        w = np.exp([sum(e[a + i, s] for i, s in enumerate(p)) + sum(crf.t[p[i], p[i + 1]] for i in range(len(p) - 1)) for p in paths])
        good = [w[[p[i] == 1 for p in paths]].sum() / w.sum() for i in range(int(b - a))]
        m = float(np.average(good, weights=size[a:b]))
        assert math.isclose(raw[d], math.log(m / (1 - m)), rel_tol=1e-9)
