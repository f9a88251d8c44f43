"""Filter interactions, exact copies and spelling variants against brute force, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from lodestream.llm import audit, exact, variants

SCHEMA = "doc_id long, text string, lang string, slot long, tag string, digest string, m long, word string, h string"


def frame(spark, rows, parts=3):
    """Rows (doc_id, text, lang) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, g, 7, "t", "d", 9, "w", "h") for i, t, g in rows], SCHEMA).repartition(parts)


def audited(rows, labels):
    """What interactions() must give, row by row."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = {}
    for part in {g or "" for _, _, g in rows}:
        fails = []
        for i, t, g in rows:
            if (g or "") == part:
                t = t or ""
                w = re.findall(r"[^\x20\x09-\x0D]+", t)
                f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
                fails.append((i, {k for k, v in f.items() if v}))
        steps = {}
        for o in permutations("ABCDE"):
            left = fails
            for step, f in enumerate(o, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                steps["".join(o), step] = (
                    f, len(left), len(gone), sum(f in x for _, x in fails) - len(gone), sum(x == {f} for _, x in fails), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                )
        shapley = Counter()
        for s in steps.values():
            shapley[s[0]] += s[2]
        out |= {(part, *k): (*s[1:], shapley[s[0]]) for k, s in steps.items()}
    return out


def test_interactions_match_brute_force(spark):
    r = random.Random(5)
    words = ["wort", "Haus", "HAUS", "é", "x", "$5", "a|b", "und"]
    texts = [None, "", " \n ", "\xa0", "A" * 100, "x " * 250, "LOUD " * 60 + "quiet " * 150] + [" ".join(r.choices(words, k=r.choice([3, 199, 200, 300]))) for _ in range(15)]
    texts += [" ".join(f"w{i}" for i in range(30_000)), " ".join(f"v{i}" for i in range(250))]
    rows = [(i, r.choice(texts), r.choice(["en", "de", "", None])) for i in range(150)]
    rows += [(300 + i, texts[6], "en") for i in range(80)]  # a group of copies with a third of all rows
    rows += [(3, "twice", "en"), (3, "twice", "en"), (3, "twice", "de"), (None, "no id", "en"), (None, "no id", "en"), (5, "no id", None), (None, texts[6], "fr")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 200, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.interactions(frame(spark, rows), marks).collect()
    assert {(x.part, x.filter_order, x.step): tuple(x)[3:] for x in got} == audited(rows, labels) and len(got) == 600 * 4
    assert audit.interactions(frame(spark, rows).limit(0), marks).count() == 0
    bare = audit.interactions(frame(spark, rows), marks.limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()
    assert tuple(bare) == (0, 0)


def test_interactions_take_thresholds_and_parts(spark):
    d = frame(spark, [(1, "a b c", "en"), (2, "A B C", "en"), (3, "a ! c", "de")])
    got = audit.interactions(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"), part="tag", least_words=3, capital_percent=50, symbols="!").where("filter_order = 'CDABE'").orderBy("step").collect()
    assert [(x.part, x.removed, x.kept) for x in got] == [("t", 1, 2), ("t", 1, 1), ("t", 0, 1), ("t", 0, 1), ("t", 0, 1)]
    with pytest.raises(ValueError, match="missing column"):
        audit.interactions(d.drop("text"), d)


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_exact_groups_match_brute_force(spark, monkeypatch, fan):
    monkeypatch.setattr(exact, "FAN", fan)
    r = random.Random(fan)
    texts = [None, "", " ", "  ", "a b", "a  b", "a\t\nb", "a\xa0b", " a b", "é", "long " * 40_000] + [f"text {i}" for i in range(30)]
    rows = [(i, r.choice(texts), "en") for i in range(200)] + [(1000 + i, "a \n b", None) for i in range(100)] + [(-5, "é", "x")]
    rows += [(None, "nameless", "en"), (None, "nameless", "en"), (7000, "same id", "en"), (7000, "same id", "en"), (7000, "other text", "en"), (None, "a b", "en")]
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(normal(t), []).append(i)
    got = exact.groups(frame(spark, rows, 11)).collect()
    least = lambda g: min((i for i in g if i is not None), default=None)
    want = Counter((i, least(groups[normal(t)]), len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t, _ in rows)
    assert Counter((x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in got) == want
    assert Counter(x.text_sha256 for x in got if x.kept) == Counter({hashlib.sha256(k.encode()).hexdigest(): 1 for k in groups})
    assert all(x.doc_id == x.keep_id for x in got if x.kept)
    kept = exact.drop_copies(frame(spark, rows, 11))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert {(x.doc_id, normal(x.text)) for x in kept.collect()} == {(least(g), t) for t, g in groups.items()} and kept.count() == len(groups)


def test_exact_groups_of_an_empty_table_and_without_python(spark):
    empty = frame(spark, []).limit(0)
    assert exact.groups(empty).count() == 0 and exact.drop_copies(empty).count() == 0
    d = exact.groups(frame(spark, [(1, "a", "b"), (2, "a", "b")]))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and [x.kept for x in d.orderBy("doc_id").collect()] == [True, False]


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) - len(b) == 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def grouped(words):
    """What group_variants() must give of {word: n}."""
    out = {}
    for w, n in words.items():
        near = sorted((-words[v], v) for v in words if v != w and one_edit(w, v))
        form = near[0][1] if near and -near[0][0] >= 10 * n else None
        out[w] = [form, n, len(near), words[form] if form else None]
    for w, x in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        x.insert(1, root)
    return {w: tuple(x) for w, x in out.items()}


def counted(rows, least=7, damage=31):
    words = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            words[w] += len(w) >= least
    return {w: n for w, n in words.items() if n >= 2}


@pytest.mark.parametrize("seed", range(60))
def test_trie_finds_all_words_one_edit_away(seed, monkeypatch):
    r = random.Random(seed)
    letters = "ab" if seed % 3 else "abcdéÿ"
    words = sorted({"".join(r.choices(letters, k=r.randint(seed % 5 > 0, 7))) for _ in range(r.randint(1, 60))}, key=lambda w: (len(w), w))
    n = np.array([r.randint(2, 5) for _ in words])
    asked = sorted({"".join(r.choices(letters, k=r.randint(1, 8))) for _ in range(40)} | set(words[:20]))
    flat, starts = variants._flat(asked)
    cut = r.randint(0, len(words))
    tries = [variants.Trie.unpacked(variants.Trie.of(w, m).packed()) for w, m in ((words[:cut], n[:cut]), (words[cut:], n[cut:])) if w]
    monkeypatch.setattr(variants, "BLOCK", r.choice([1, 7, 100]))
    got = {asked[i]: (c, m, b) for i, c, m, b in variants._best(asked, flat, starts, tries)}
    for a in asked:
        near = sorted((-int(n[j]), b) for j, b in enumerate(words) if a != b and one_edit(a, b))
        assert got.get(a) == ((len(near), -near[0][0], near[0][1]) if near else None), a


@pytest.mark.parametrize("small", [False, True])
def test_spelling_variants_match_brute_force(spark, monkeypatch, small):
    if small:  # many shards, a round each, and blocks of a few words
        for k, v in {"SHARD_WORDS": 9, "ROUND_BYTES": 1, "TASK_WORDS": 20, "BLOCK": 4}.items():
            monkeypatch.setattr(variants, k, v)
    r = random.Random(3)
    base = ["colourful", "Wirtschaft", "Élèvement", "aaaaaaa", "aaaaaaaa", "abababab", "×÷×÷×÷×", "maßnahme", "MASSNAHME", "sevenle", "sixxxx"]
    rows = [(i, " ".join(r.choices(base, k=80))) for i in range(60)] + [(None, "Wirtschaft, wirtschaft; Wirtschfat"), (None, None), (5, ""), (5, "1 2_3"), (6, " x-" * 50)]
    rows += [(200 + i, "colorful colourfull Wirtschafft wirtschaf aaaaaaab aaaaaab " + "".join(r.choices("ab", k=8))) for i in range(12)] + [(900, "z" * 3000 + " " + "z" * 3001)] * 2
    words = counted(rows)
    got = variants.spelling_variants(spark.createDataFrame([(i, t, "w") for i, t in rows], "doc_id long, text string, word string").repartition(5)).collect()
    assert {x.word: tuple(x)[1:] for x in got} == grouped(words) and len(got) == len(words)


def test_forms_lead_to_their_root_and_empty_tables(spark):
    words = {"aaaaaaaa": 2, "aaaaaaab": 20, "aaaaaabb": 200, "aaaaabbb": 2000, "aaaabbbb": 20_000, "other": 5, "others": 5}
    words |= {f"{c}aaaaabbb": 2 for c in "abcdefg"} | {"tiebreakx": 50, "tiebreaky": 50, "tiebreakz": 2}
    got = {x.word: x for x in variants.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert {w: tuple(x)[1:] for w, x in got.items()} == grouped(words)
    assert got["aaaaaaaa"].root == "aaaabbbb" and got["tiebreakz"].form == "tiebreakx"
    docs = spark.createDataFrame([], "doc_id long, text string")
    none = variants.spelling_variants(docs)
    assert none.count() == 0 and none.columns == ["word", "form", "root", "n", "n_near", "form_n"]
