"""Urls, pages, crawl records, vectors and the pipeline."""

import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import htmltext, nndescent, urlfilter, warc
from lodestream.llm.queries import URL_RULES


def test_url_rules_match_brute_force(spark):
    r = random.Random(1)
    hosts = ["a.org", "example.org", "x.example.org", "notexample.org", "shop.com", "a.b.com", "COM", "example.org.", "x.net", "", ".org"]
    paths = ["/", "/es/", "/es/1", "/en/1", "/en/12?x=/es/", "/fr/", "/de/a#b", "", "/FR/"]
    urls = [f"{r.choice(['http', 'https'])}://{r.choice(hosts)}{r.choice(paths)}" for _ in range(300)] + [None, "no scheme", "x://y://org/", "http://EXAMPLE.org/es/é"] + ["http://hot.example.org/es/"] * 200
    rules = [*URL_RULES, ("x.example.org", "/es/", "allow"), ("", "/de/a", "block"), ("example.org", "/es/", "block")]
    got = urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, chunk=3).collect()
    assert len(got) == len(urls)
    for g in got:
        u = urls[g.page_id]
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
            path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits) if fits else (0, 0, 0, None, "allow")
        assert (g.host, g.path, g.rule, g.verdict) == (host, path, *want[3:]), u
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0


PAGE = """<!doctype html><html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<div class="ad">Buy this now. It is good.</div><article><h1>A &amp; B title of it</h1><p><b>First one is here.<br><p>Second&nbsp;paragraph   of the text, with more words.</p><ul><li>An item of the article, too.</li></ul></article>
<div id="comments"><h3>Comments</h3><p>I like that. Great post.</p></div><aside><p>Related things to read on.</p></aside><form><label>Mail</label><input></form><footer>&copy; 2024 some site</footer></body></html>"""


def test_many_nested_rules_match_brute_force(spark):
    """Rules as a table, nested in hosts and paths, in chunks that break a host's rules."""
    r = random.Random(9)
    hosts = ["", "org", "example.org", "a.example.org", "b.a.example.org", "xexample.org", "com", "x.com"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/a/b/c", "/ab", "/b", "a", "/ä/"]
    rules = [(r.choice(hosts), r.choice(paths), r.choice(["allow", "block"])) for _ in range(120)] + [(None, "/q", "block")]
    urls = [f"http://{r.choice(hosts)}{r.choice(['', '', '.', ':80'])}{r.choice(paths)}{r.choice(['', 'b', '/c', '?a=/a', 'x' * 30_000])}" for _ in range(400)] + [None, "", "no scheme/a"]
    d = spark.createDataFrame([(i % 390, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")  # a clashing name
    got = [urlfilter.judge(d, spark.createDataFrame(rules, "host string, path string, verdict string"), "none", chunk=c).collect() for c in (1000, 17)]
    got.append(urlfilter.judge(d, rules, "none").collect())
    assert all(sorted(map(str, g)) == sorted(map(str, got[0])) for g in got) and len(got[0]) == len(urls)
    for x in got[0]:
        fit = [(len(h or "") + len(p), len(h or ""), v == "block", (h or "") + p, v) for h, p, v in rules if (not h or x.host == h or x.host.endswith("." + h)) and x.path.startswith(p)]
        assert (x.rule, x.verdict) == (max(fit)[3:] if fit else (None, "none")), x
    assert urlfilter.judge(d, []).where("verdict <> 'allow' or rule is not null").count() == 0 and urlfilter.judge(d.limit(0), rules).count() == 0


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain <"), (5, "u", "<p>unclosed <!-- never"), (1, "u", PAGE)]
    got = sorted(htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect(), key=lambda r: r.page_id)
    want = "A & B title of it First one is here. Second paragraph of the text, with more words. An item of the article, too."
    assert [got[0].text, got[1].text, got[2].text, got[3].text] == [want, want, "", ""] and got[0].n_chars == len(want)
    assert len(got) == 6 and htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_unseen_labelled_pages():
    model, wrong, total = htmltext.default_model(), 0, 0
    for blocks, y in htmltext._labelled(200, seed=91):
        if blocks:
            wrong += int((model.viterbi(*htmltext._many([blocks])) != np.array(y)).sum())
            total += len(y)
    assert total > 2000 and wrong < 0.01 * total


def test_revisits(spark):
    rec = "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, headers map<string,string>"
    rows = [
        (1, "http://www.a.org/x/?b=2&a=1&utm_x=3#f", 10, "response", 200, '"e1"', None, {"ETag": '"e1"', "Content-Type": "t", "Date": "d1"}),
        (2, "https://a.org/x?a=1&b=2", 20, "response", 200, '"e2"', "m", {"Content-Type": "t2"}), (3, "http://a.org/x?a=1&b=2", 25, "response", 404, None, None, None),
        (4, "http://A.org:80/x?b=2&a=1", 15, "revisit", 304, 'W/"e1"', None, {"Date": "d2", "Content-Type": "no", "Set-Cookie": "no"}), (5, "http://a.org/x?a=1&b=2", 20, "revisit", 304, '"e2"', None, {}),
        (6, "http://a.org/x?a=1&b=2", 30, "revisit", 304, None, "m", None), (7, "http://a.org/x?a=1&b=2", 31, "revisit", 304, None, None, {}), (8, "http://a.org/x?a=1&b=2", 5, "revisit", 304, '"e1"', None, {}),
        (9, None, None, "revisit", 304, None, None, None), (10, "http://other.org/", 99, "revisit", 304, None, None, {}),
    ]
    for slots in (1, 3, 256):
        got = {r.record_id: (r.state, r.response_id) for r in warc.resolve_revisits(spark.createDataFrame(rows, rec), slots).collect()}
        assert got == {4: ("resolved", 1), 5: ("mismatch", 1), 6: ("resolved", 2), 7: ("unverified", 2), 8: ("missing", None), 9: ("missing", None), 10: ("missing", None)}
    head = next(r.headers for r in warc.resolve_revisits(spark.createDataFrame(rows, rec)).collect() if r.record_id == 4)
    assert head == {"etag": '"e1"', "content-type": "t", "date": "d2"}
    assert warc.resolve_revisits(spark.createDataFrame([], rec)).count() == 0


def test_header_names_that_differ_in_case_and_odd_tables(spark):
    kinds = "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, headers map<string,string>, slot string, head string, canonical string"
    row = lambda i, ts, kind, headers, url="http://a.org/x": (i, url, ts, kind, 200 if kind == "response" else 304, '"t"', None, headers, "s", "h", "c")
    rows = [row(1, 1, "response", {"Date": "1", "date": "2", "DATE": "0", "Server": "s"}), row(2, 2, "revisit", {"ETag": "a", "etag": "b", "Server": "other"}), row(3, 3, "revisit", None), row(4, None, "revisit", {}), row(5, 5, "revisit", {}, None)]
    rows += [row(2, 2, "revisit", {"ETag": "a", "etag": "b", "Server": "other"}), row(None, 9, "revisit", {"x": None}), row(7, 7, None, {}), row(8, 8, "response", None, "x" * 100_000)]
    for slots in (None, 2):
        got = warc.resolve_revisits(spark.createDataFrame(rows, kinds), slots).collect()
        by = {x.record_id: x for x in got}
        assert len(got) == 6 and sum(x.record_id == 2 for x in got) == 2
        assert by[2].state == "resolved" and by[2].headers == {"date": "2", "server": "s", "etag": "b"} and by[3].headers == {"date": "2", "server": "s"}
        assert by[4].state == by[5].state == "missing" and by[None].state == "resolved"
        assert warc.resolve_revisits(spark.createDataFrame([], kinds), slots).count() == 0


def test_revisit_edges(spark):
    rec = "record_id long, url string, refers_url string, ts long, kind string, status int, etag string, last_modified string, headers map<string,string>, canonical string, slot string"
    long = "http://a.org/" + "x" * 100_000
    rows = [
        (1, None, None, 1, "response", 200, None, None, {}, "c", "s"), (2, None, None, 5, "revisit", 304, None, None, {}, "c", "s"), (3, "no scheme", None, 6, "revisit", 304, None, None, {}, "c", "s"),
        (4, "http://b.org/", None, -10**12, "response", 200, "e", None, {}, "c", "s"), (5, "http://c.org/", "http://b.org", 7, "revisit", 304, "e", None, {}, "c", "s"), (5, "http://c.org/", "http://b.org", 7, "revisit", 304, "e", None, {}, "c", "s"),
        (6, long, None, 8, "response", 200, None, None, None, None, None), (7, long, None, 9, "revisit", 304, None, None, {"ETag": "y" * 50_000}, None, None), (8, long, None, None, "revisit", 304, None, None, None, None, None),
    ]
    got = sorted((r.record_id, r.state, r.response_id) for r in warc.resolve_revisits(spark.createDataFrame(rows, rec)).collect())
    assert got == [(2, "missing", None), (3, "missing", None), (5, "resolved", 4), (5, "resolved", 4), (7, "unverified", 6), (8, "missing", None)]


def test_broken_gzip_tails_end_the_iteration():
    one = warc.write_record("response", "<r1>", "http://a.org/", "d", 200, {"ETag": "x"}, b"p" * 300_000)
    two = warc.write_record("response", "<r2>", "http://a.org/", "d", 200, {}, b"q")
    whole = gzip.compress(one) + gzip.compress(two)
    assert [(r["record_id"], len(r["payload"])) for r in warc.parse_warc(whole)] == [("<r1>", 300_000), ("<r2>", 1)]
    assert [r["record_id"] for r in warc.parse_warc(whole[:-9])][:1] == ["<r1>"]
    assert [r["record_id"] for r in warc.parse_warc(gzip.compress(one) + b"\x1f\x8bgarbage")] == ["<r1>"]
    assert list(warc.parse_warc(b"\x1f\x8b")) == list(warc.parse_warc(b"")) == []


def test_revisits_of_a_hot_url_match_brute_force(spark):
    r = random.Random(4)
    rows = [(i, "http://hot.org/" if r.random() < 0.6 else f"http://u{r.randint(0, 5)}.org/", r.randint(0, 300), r.choice(["response", "revisit"]), 200, str(r.randint(0, 3)), None, {}) for i in range(400)]
    got = {g.record_id: g.response_id for g in warc.resolve_revisits(spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, headers map<string,string>"), 16).collect()}
    for i, u, t, kind, *_ in rows:
        if kind == "revisit":
            before = [(x[2], x[0]) for x in rows if x[3] == "response" and x[1] == u and x[2] < t]
            assert got[i] == (max(before)[1] if before else None)


def test_warc_files_round_trip(spark, tmp_path):
    recs = [("response", "<urn:1>", "http://a/", "2024-01-01T00:00:00Z", 200, {"ETag": '"x"', "Content-Type": "text/html"}, b"<p>\r\n\r\nhi\xff"), ("revisit", "<urn:2>", "http://a/", "2024-01-02T00:00:00Z", 304, {"Date": "d"}, b"")]
    data = b"".join(warc.write_record(*r) for r in recs)
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(warc.write_record(*r)) for r in recs))
    got = warc.read_warc(spark, str(tmp_path)).orderBy("record_id").collect()
    assert [(g.kind, g.status, bytes(g.payload), g.etag) for g in got] == [("response", 200, recs[0][6], '"x"')] * 2 + [("revisit", 304, b"", None)] * 2


def test_nearest_neighbours_and_ties(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16))
    x = (centres[rng.integers(0, 6, 900)] + 0.6 * rng.normal(size=(900, 16))).astype(np.float32)
    x[100:400] = x[100]  # a third of the vectors is one
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [1.0]), (None, [1.0] * 16), (7, x[7].tolist())]
    got = nndescent.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, 20).toPandas()
    hit, d, ids = 0, np.vstack([x, np.eye(1, 16)]).astype(np.float64), np.r_[np.arange(900), 904]  # 904 is filled up with zeros
    at = {v: i for i, v in enumerate(ids.tolist())}
    for q in range(0, 900, 20):
        s = d @ d[q]
        s[q] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        g = got[got.query_id == q].sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and np.allclose(g.score, s[[at[v] for v in g.vec_id]], rtol=1e-12)
        hit += len(set(want) & set(g.vec_id))
    assert hit >= 0.95 * 20 * 45 and not set(got.query_id) & {900, 920}
    few = nndescent.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>"), F.col("vec_id") == 0, 20)
    assert few.count() == 2
    assert nndescent.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).count() == 0


def test_search_goes_on_until_nothing_changes(spark):
    x = np.random.default_rng(3).normal(size=(6000, 48)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    index = nndescent.Index(d, degree=4)  # a graph so poor that a fixed number of hops ends too early
    got = index.search(d.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q")), 20).toPandas()
    index.drop()
    hit = sum(len(set(np.argsort(-(x @ x[q]))[:20]) & set(got[got.q == q].v)) for q in range(0, 6000, 100))
    assert hit >= 0.9 * 20 * 60, hit / 1200


def test_pipeline_stages_follow_each_other(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(6)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    good = ["\n".join(text(14) for _ in range(4)) for _ in range(60)]
    bad = ["\n".join(text(14).upper().replace(" ", "!! ") for _ in range(4)) for _ in range(30)]
    item, shared = " ".join(word() for _ in range(30)), text(60)
    docs = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate([*good, *bad])]
    docs += [(200, good[3], "en", "src0", 1), (201, text(20) + "\n" + item + "\n" + text(20), "en", "src1", 1), (202, text(30) + " " + shared, "en", "src1", 1), (203, shared + " " + text(30), "en", "src2", 1), (204, None, None, None, None), (3, good[3], "en", "src0", 1)]
    sf = str(tmp_path)
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, kinds).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    d, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        stage(spark, d, sf).write.parquet(f"{sf}/out-{name}")
        d = spark.read.parquet(f"{sf}/out-{name}")
        seen[name] = {x.doc_id: x for x in d.collect()}
        if name != "mix":
            assert d.columns == [x.split()[0] for x in kinds.split(", ")]
    clean = {i for i in range(60)} | {201, 202, 203}
    assert set(seen["quality"]) == clean | {200} and set(seen["near_dedup"]) == clean
    assert seen["repeats"][202].text.endswith(shared) and shared[:40] not in seen["repeats"][203].text and seen["repeats"][203].n_chars == len(seen["repeats"][203].text)
    assert all(seen["repeats"][i].text == good[i] for i in range(60)) and set(seen["decontaminate"]) == clean - {201}
    assert set(seen["mix"]) <= set(seen["decontaminate"]) and all(x.mix_copies in (1, 2) for x in seen["mix"].values())
    assert {x.doc_id for x in pipeline.run(spark, sf).collect()} == set(seen["mix"])
