"""Deduplication, review linkage, evaluation, reports, replay, sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from lodestream.operators import dedup, diagnose, evaluate, replay, rules, validate
from lodestream.sources import readers, writers
from lodestream.spec import MISSING, RECORD_COLUMNS

REC = "compound_id string, smiles string, target_type string, target_relation string, target_value string, target_units string, bacteria string, evidence_id string, ord int, warnings array<string>, source_text string"


def records(spark, rows):
    return spark.createDataFrame([(c, MISSING, "MIC", "=", v, "µM", "E. coli", e, i, w, "t") for i, (c, v, e, w) in enumerate(rows)], REC)


def one(spark, f, *cells):
    d = spark.createDataFrame([cells], ", ".join(f"c{i} string" for i in range(len(cells))))
    return d.select(f(*[F.col(f"c{i}") for i in range(len(cells))]).alias("x")).first().x


def test_merge_keeps_the_first_and_all_warnings(spark):
    r = records(spark, [("1", "4", "e1", ["b"]), ("1", "4", "e1", ["a", "b"]), ("1", "8", "e1", []), ("1", "4", "e2", [])])
    m = {(x.target_value, x.evidence_id): x for x in dedup.merged(r, ["ord"]).collect()}
    assert len(m) == 3 and m["4", "e1"].duplicate_count == 2 and m["4", "e1"].ord == 0 and m["4", "e1"].warnings == ["b", "a"]
    again = dedup.merged(dedup.merged(r, ["ord"]).drop("duplicate_count"), ["ord"])
    assert again.count() == 3 and again.agg(F.max("duplicate_count")).first()[0] == 1
    c = dedup.conflicts(r).collect()
    assert len(c) == 1 and len(c[0].rows) == 2


def test_duplicate_status(spark):
    r = records(spark, [("1", "4", "e1", []), ("1", "4", "e1", []), ("1", "4", "e2", []), ("2", "4", "e1", [])])
    got = {x.ord: (x.duplicate_status, x.duplicate_count) for x in dedup.duplicate_status(r).collect()}
    assert got == {0: ("duplicate_same_evidence", "3"), 1: ("duplicate_same_evidence", "3"), 2: ("repeated_distinct_evidence", "3"), 3: ("unique", "1")}
    d = dedup.duplicate_diagnostics(r).first()
    assert (d.exact_duplicate_rows, d.duplicates_with_same_evidence, d.repeated_with_other_evidence) == (2, 1, 3)


def test_candidate_conflicts(spark):
    r = records(spark, [("1", "4", "e", []), ("1", "4", "e", []), ("1", "5", "e", [])]).withColumnRenamed("ord", "candidate_index")
    got = {(x.kind, tuple(x.indexes)) for x in dedup.candidate_conflicts(r).collect()}
    assert got == {("duplicate", (0, 1)), ("conflict", (0, 1, 2))}


def test_members_of_a_hot_key(spark):
    """Half of all rows under one key: rows beside their class, and neither a list nor a window in the plan."""
    n = F.col("id")
    hot = spark.range(40000).select(
        F.when(n % 2 == 0, "hot").when(n % 10 == 1, None).otherwise(n.cast("string")).alias("compound_id"), F.lit(MISSING).alias("smiles"), F.lit("MIC").alias("target_type"), F.lit("=").alias("target_relation"),
        (n % 5000).cast("string").alias("target_value"), F.lit("µM").alias("target_units"), F.lit("E. coli").alias("bacteria"), n.cast("int").alias("candidate_index"), F.lit("clash").alias("first"), F.lit("clash").alias("n"),
    )
    c = dedup.conflict_members(hot)
    got = c.collect()
    assert len([x for x in got if x.compound_id == "hot"]) == 2500 and all((x.n_same, x.n_rows) == (8, 2500) for x in got if x.compound_id == "hot")
    m = dedup.candidate_members(hot)
    kinds = {(x.kind, x.hot): x["count"] for x in m.groupBy("kind", F.col("key").startswith("hot").alias("hot")).count().collect()}
    # null compounds (one in ten) are equal to each other
    assert kinds == {("duplicate", True): 17500, ("conflict", True): 20000, ("duplicate", False): 3500, ("conflict", False): 4000}
    assert m.where("kind = 'conflict' and key like 'hot%'").agg(F.max("first"), F.count_distinct("index")).first() == (0, 20000)
    for d in (c, m):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "collect_" not in plan and "Window" not in plan
    empty = hot.limit(0)
    assert dedup.conflict_members(empty).count() == 0 and dedup.candidate_members(empty).count() == 0


@pytest.mark.parametrize(
    ("label", "text", "want"),
    [("4b", "The compounds 4a–4d were active", "compounds 4a–4d"), ("5a", "5a | 12 | 3\n5b | 1", "5a"), ("7", "values 7 and 12", "not available"), ("3c", "a benzimidazole derivative (3c) of", "benzimidazole derivative (3c)"), (MISSING, "x", "not available"), ("9z", "compound 9a-9c only", "not available")],
)
def test_compound_mention(spark, label, text, want):
    assert one(spark, dedup.compound_mention, label, text) == want


def test_snippet(spark):
    text = "a" * 2000 + " 5a " + "b" * 2000
    got = one(spark, lambda t, c, v: dedup.snippet(t, c, v), text, "5A", "7")
    assert len(got) <= 1206 and got.startswith("...") and got.endswith("...") and " 5a " in got
    assert one(spark, lambda t, c, v: dedup.snippet(t, c, v), " short  text ", "5a", "7") == "short text"


def test_links_and_review(spark):
    r = records(spark, [("1", "4", "e1", []), ("2", "5", "rule-2", [])])
    f = "source_file string, page int, section string, table_id string, row_id string, evidence_text string, extraction_method string, confidence double"
    ev = spark.createDataFrame([("e1", "a.pdf", 1, None, None, None, "compound 1 has 4", "m", 0.6)], "evidence_id string, " + f)
    ru = spark.createDataFrame([(1, "a.pdf", 2, None, "t1", "r", "2 | 5", "m", 0.7)], "rule_index long, " + f)
    got = {x.compound_id: x for x in dedup.link_evidence(r, ev, ru).collect()}
    assert got["1"].evidence_text == "compound 1 has 4" and got["2"].page == 2
    rev = dedup.review_rows(dedup.link_evidence(r, ev, ru))
    assert len(rev.columns) == 24 and {(x.source_kind, x.compound_label_found) for x in rev.collect()} == {("text", "found"), ("table", "found")}


def test_evidence_id_is_stable(spark):
    import hashlib

    want = "ev:" + hashlib.sha1("a.pdf|1||t|r|text".encode()).hexdigest()[:12]
    assert one(spark, lambda *c: dedup.evidence_id(*c), "a.pdf", "1", None, "t", "r", " text ") == want


def fields():
    return {c: evaluate.canonical(c, F.col(c)) for c in RECORD_COLUMNS}


def gold(spark, rows):
    return spark.createDataFrame([(p, c, MISSING, "MIC", "=", v, "µM", b) for p, c, v, b in rows], "pdf string, " + ", ".join(f"{c} string" for c in RECORD_COLUMNS))


def test_metrics(spark):
    p, t = gold(spark, [("A.pdf", "1", "5", "E. coli"), ("a", "1", "5", "x"), ("b", "2", "1", "y")]), gold(spark, [("a.PDF", "1", "5.0", "Escherichia coli"), ("b", "3", "2", "y")])
    m = {x.field: x for x in evaluate.field_metrics(p, t, fields()).collect()}
    assert m["target_value"].true_positive == 1 and m["bacteria"].true_positive == 2 and m["smiles"].true_positive == 2
    assert all(x.true_positive <= min(x.predicted, x.gold) for x in m.values()) and len(m) == 7
    s = evaluate.summary(evaluate.field_metrics(p, t, fields())).first()
    assert abs(s.macro_f1 - s.f1_of_means) < 1e-12
    key = evaluate.document_key(F.col("pdf"))
    docs = spark.createDataFrame([("a",), ("b",), ("none",)], "doc string")
    by = evaluate.field_metrics(p.withColumn("doc", key), t.withColumn("doc", key), fields(), ["doc"], docs)
    got = {x.doc: x.macro_f1 for x in evaluate.summary(by, ["doc"]).collect()}
    assert got["none"] == 0 and 0 < got["a"] < 1 and 0 < got["b"] < 1
    same = evaluate.summary(evaluate.field_metrics(t, t, fields())).first()
    assert same.macro_f1 == 1.0


def test_scopes_and_names(spark):
    t = spark.createDataFrame([("X1.pdf", "10.1/A"), ("y", "10.1/b")], "pdf string, doi string")
    assert evaluate.scope(t, "x1").count() == 1 and evaluate.scope(t, "x1", {"10.1/b"}).first().pdf == "X1.pdf"
    assert evaluate.scope(t, None, {"10.1/B"}).first().pdf == "y" and evaluate.scope(t).count() == 2
    assert one(spark, lambda c: evaluate.document_key(c, prefix=True), "12_Name.PDF") == "name" and one(spark, lambda c: evaluate.document_key(c, keep_case=True), "Name.pdf") == "Name"
    with pytest.raises(ValueError, match="columns must be"):
        evaluate.check_columns(t, ("doi", "pdf"))
    assert one(spark, lambda c: evaluate.canonical("target_relation", c), "==") == ""


def test_worst_fields_and_recall(spark):
    m = spark.createDataFrame([("bacteria", 0.0), ("target_units", 0.25), ("target_type", 1.0)], "field string, f1 double")
    assert evaluate.worst_fields(m).first().worst_fields == "bacteria;target_units"
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert evaluate.set_recall(a, b, ["k"]).first().recall == 0.5
    assert spark.range(1).select(evaluate.ready(F.lit(True), F.lit(None).cast("boolean")).alias("x")).first().x is False
    assert spark.createDataFrame([(96, 100), (0, 0)], "v int, t int").agg(evaluate.valid_ratio(F.col("v"), F.col("t")).alias("x")).first().x is True


def test_confidence_report(spark):
    docs = spark.createDataFrame([("none", 0), ("good", 1)], "source_file string, tables int")
    chunks = spark.createDataFrame([("good", 1, "t")], "source_file string, page int, table_id string")
    raw = records(spark, [("1", "4", "e", [])]).withColumn("source_file", F.lit("good"))
    checked = raw.select("*", F.lit(None).cast("string").alias("error"), F.lit(1).alias("page"), F.lit("t").alias("table_id"), F.lit("x.table").alias("extraction_method"), F.lit(0.85).alias("confidence"))
    r = {x.source_file: x for x in diagnose.confidence_report(docs, chunks, raw, checked).collect()}
    assert r["good"].confidence == "high" and not r["good"].should_run_model and r["good"].signals["average_record_confidence"] == 0.85
    assert r["none"].confidence == "low" and [i.code for i in r["none"].issues] == ["no_evidence", "no_parsed_tables"] and len(r["none"].signals) == 14


def test_audit(spark):
    docs = spark.createDataFrame([("a", 0, 5), ("b", 3, 5), ("c", 0, 0), ("d", 9, 9)], "source_file string, rows int, gold int")
    art = spark.createDataFrame([("a", True, 2, 1, 0, 0)], "source_file string, parsed boolean, text_blocks int, tables_found int, chunks_found int, candidates_found int")
    rep = spark.createDataFrame([("a", {"evidence_chunks": 4.0})], "source_file string, signals map<string,double>")
    got = {x.source_file: (x.row_bucket, x.failure_stage) for x in diagnose.document_audit(docs, art, rep).collect()}
    assert got == {"a": ("zero-row", diagnose.NO_CANDIDATES), "b": ("low-row", diagnose.UNKNOWN), "c": ("expected-zero", diagnose.EXPECTED_ZERO), "d": ("ok", diagnose.UNKNOWN)}
    assert one(spark, diagnose.next_action, diagnose.NO_PARSE).startswith("Inspect parser")


def test_rejection_categories(spark):
    e = "missing required evidence-backed values: compound_id, bacteria"
    f = one(spark, diagnose.rejection_fields, e)
    assert f == ["compound_id", "bacteria"]
    cat = lambda e, miss: one(spark, lambda c: diagnose.rejection_categories(c, diagnose.rejection_fields(c), F.array(*map(F.lit, miss)).cast("array<string>")), e)
    assert cat(e, ["compound_id", "bacteria"]) == ["missing required field", "bacteria normalization problem", "compound_id parsing problem"]
    assert cat("target_value is not supported by evidence text: 4", []) == ["invalid target value"] and cat("odd", []) == ["unknown"]


def test_replay(spark):
    d = spark.createDataFrame([("a", i, f"value {i}") for i in range(5)], "doc string, ord int, text string")
    b = replay.batches(d, 2, ["doc"], ["ord"])
    assert [x.batch for x in b.orderBy("ord").collect()] == [0, 0, 1, 1, 2]
    assert replay.pending(b, b.where("batch = 1"), ["doc", "batch"]).count() == 3
    want = spark.createDataFrame([("a", [3, 9, 0])], "doc string, indexes array<int>")
    assert [x.ord for x in replay.select_by_index(d, want, ["doc"], ["ord"]).orderBy("replay_ord").collect()] == [3, 0]
    good, bad = json.dumps([{"target_value": "3"}]), json.dumps([{"target_value": "3"}, {"target_value": "77"}])
    r = spark.createDataFrame([("a", 0, good, "is 3"), ("a", 1, bad, "is 3"), ("a", 2, "{", "x"), ("a", 3, "[]", "x")], "doc string, chunk_index int, response string, text string")
    c = replay.extractor_counts(replay.parse_strict(r), ["doc"]).first()
    assert (c.responses, c.valid_responses, c.records) == (4, 2, 1)
    held = spark.createDataFrame([(json.dumps({"records": [{"compound_id": "1"}]}),), ("no json",), ('{"x": 1}',), ("[]",)], "response string")
    p = replay.parse_lenient(held).collect()
    assert [x.item.compound_id for x in p if x.item] == ["1"] and sorted(x.warning for x in p if x.warning) == ["Invalid JSON response", "LLM response must be a JSON array."]
    st = lambda *s: spark.createDataFrame([(x,) for x in s], "status string").agg(replay.combined_status().alias("s")).first().s
    assert [st("live", "cached_live"), st("disabled"), st("replay"), st("live", "replay"), st("llm_error", "replay"), st("b", "a"), st()] == ["live", "disabled", "replay", "partial_live", "llm_error", "a,b", "live"]


def test_supervised_candidates(spark):
    plan = spark.createDataFrame([("ev_0001", "MIC 4 for 5a", "a.pdf", 1)], "evidence_id string, text string, source_file string, page int")
    rows = [(0, "ev_0001", "5a", None, "MIC", "=", "4", "mM", "E. coli"), (1, "ev_0009", "5b", "C(C", "MIC", "=", "5", "mM", "E. coli"), (2, "ev_0001", "5a", "C(C", "MIC", "=", "9", None, "E. coli")]
    cand = spark.createDataFrame(rows, "candidate_index int, evidence_id string, " + ", ".join(f"{c} string" for c in RECORD_COLUMNS))
    out = replay.supervise(plan, cand)
    assert {(x.candidate_index, x.status) for x in out["issues"].collect()} == {(1, "unknown_evidence"), (2, "missing_value"), (2, "unsupported_value")}
    assert {x.candidate_index: x.status for x in out["structures"].collect()} == {0: "not_applicable", 2: "invalid"}
    assert [x.kind for x in out["conflicts"].collect()] == ["conflict"]
    with pytest.raises(NotImplementedError):
        replay.live()


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("B.pdf", "a.PDF", "x.txt"):
        (tmp_path / "in" / n).write_bytes(b"%PDF")
    files = readers.listing(spark, str(tmp_path / "in"))
    assert [r.name for r in files.collect()] == ["a.PDF", "B.pdf"]
    assert readers.included(files, ["A.pdf"]).count() == 1
    with pytest.raises(ValueError, match="zz.pdf"):
        readers.included(files, ["zz.pdf"])
    bad = readers.read_pdfs(spark, str(tmp_path / "in")).collect()
    assert len(bad) == 2 and {r.status for r in bad} == {"failed"} and all(r.error for r in bad)
    (tmp_path / "g.csv").write_text('﻿a,b\n"x, ""q""",\n', encoding="utf-8")
    g = readers.read_strings(spark, str(tmp_path / "g.csv"))
    assert g.columns == ["a", "b"] and tuple(g.first()) == ('x, "q"', "")
    d = spark.createDataFrame([("1", "2")], "b string, a string")
    writers.write_table(d, str(tmp_path / "o" / "k1.csv"), ("a", "b"))
    assert readers.read_predictions(spark, str(tmp_path / "o" / "*.csv"), ("a", "b")).first().a == "2"
    with pytest.raises(Exception, match="."):
        readers.read_predictions(spark, str(tmp_path / "o" / "*.csv"), ("b", "a")).collect()
    with pytest.raises(ValueError, match="extra"):
        writers.write_table(d, str(tmp_path / "no"), ("a",))
    assert writers.markdown("T", d).splitlines()[2] == "| b | a |"
    s = readers.first_available("k", spark.createDataFrame([("x", 1)], "k string, v int"), spark.createDataFrame([("x", 2), ("y", 3)], "k string, v int"))
    assert {(r.k, r.v) for r in s.collect()} == {("x", 1), ("y", 3)}
    assert one(spark, lambda c: readers.tolerant_json(c, "a int"), '{"a": 1}').a == 1 and one(spark, lambda c: readers.tolerant_json(c, "a int"), "{") is None
    assert one(spark, readers.clean_cell, " a  b \n\n c ") == "a b\nc"


def test_suppression_is_null_safe(spark):
    d = spark.createDataFrame([("a", None), ("a", 1), ("b", None)], "source_file string, page int")
    assert [tuple(r) for r in rules.suppress(d, d.where("source_file = 'a' and page is null")).collect()] == [("a", 1), ("b", None)]


def test_inventory(spark):
    a, b = spark.createDataFrame([("x",), ("y",), ("x",)], "k string"), spark.createDataFrame([("y",), ("z",)], "k string")
    assert {(r.k, r.status) for r in diagnose.inventory(a, b, "k").collect()} == {("x", "missing"), ("y", "existing"), ("z", "extra")}


# Structures as a chemist writes them, and texts that are none
STRUCTURES = (
    "C", "CC", "C=C", "C#N", "[Na+].[Cl-]", "c1ccccc1", "C1CC1", "CC(C)C", "CC(=O)O", "OC(=O)c1ccccc1", "C(C)(C)C", "N[C@@H](C)C(=O)O", "F/C=C/F", "F/C=C\\F", "C1CCC2CCCCC2C1",
    "c1ccc2[nH]cnc2c1", "[13CH4]", "[Fe+2]", "[Cu++]", "[O-]S(=O)(=O)[O-]", "BrCCl", "C%12CCCC%12", "C=1CCCCC1", "C(C(C(C)))C", "[H]O[H]", "c1cc[n+]([O-])cc1", "[C@H](F)(Cl)Br", "CC.O", "C1CC1C1CC1", "[nH]1cccc1", "B(O)O", "S", "*C", "P(=O)(O)O", "[CH3:1]C",
)
NOT_STRUCTURES = (
    "C1CC", "C(C", "CC)", "C()C", "(C)C", "=C", "C=", "C==C", "C(=)C", "C..C", ".C", "C.", "[C", "C]", "[]", "C[Na", "Xx", "C1CC2", "C11", "1CC1", "C(C))C(", "C%1C", "C%12CC", "hello world", "C C", "C-", "[+]", "C(.C)", "[C+-]", "C$$C", "",
)


def test_structure_grammar(spark):
    d = spark.createDataFrame([(x, True) for x in STRUCTURES] + [(x, False) for x in NOT_STRUCTURES], "s string, ok boolean")
    got = d.select("s", "ok", validate.well_formed(F.col("s")).alias("is")).collect()
    assert [(x.s, x.ok) for x in got if x["is"] != x.ok] == []
    long = "C(" * 3000 + "C" + ")" * 3000
    deep = spark.createDataFrame([(long,), (long + ")",), (None,)], "s string").select(validate.well_formed(F.col("s")).alias("x"))
    assert [x.x for x in deep.collect()] == [True, False, None]
    status = d.where("s = 'C1CC'").select(validate.structure_status(F.col("s"), validate.well_formed(F.col("s"))).alias("x")).first().x
    assert status == "invalid"


def test_metrics_by_level_equal_both_passes(spark):
    row = "d string, a string, b string"
    p = spark.createDataFrame([("x", "1", "u"), ("x", "1", None), ("y", "2", "u"), (None, "1", "v")], row)
    t = spark.createDataFrame([("x", "1", "u"), ("y", "1", "u"), ("z", "", "v"), (None, "1", "v")], row)
    fields = {c: F.coalesce(F.col(c), F.lit("")) for c in "ab"}
    for pred, gold in ((p, t), (p, t.limit(0)), (p.limit(0), t.limit(0))):
        got = evaluate.metrics_by_level(pred, gold, fields, ["d"])
        cols = ["field", "true_positive", "predicted", "gold", "precision", "recall", "f1"]
        rows = lambda d: sorted(map(tuple, d.collect()), key=repr)
        assert rows(got.where("level = 'all'").select(*cols)) == rows(evaluate.field_metrics(pred, gold, fields).select(*cols))
        assert rows(got.where("level = 'group' and d is not null").select("d", *cols)) == rows(evaluate.field_metrics(pred, gold, fields, ["d"]).where("d is not null").select("d", *cols))
