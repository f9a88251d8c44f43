"""Files that a run leaves and reads again, and what is refused."""

import json

import pytest
from pyspark.sql import functions as F

from lodestream.operators import dedup, diagnose, evaluate, replay
from lodestream.sources import readers, writers
from lodestream.spec import RECORD_COLUMNS


def records(spark, n=3):
    rows = [("c1", "NOT_DETECTED", "MIC", "=", "4", "µM", "E. coli", f"e{i % 2}", [f"w{i}", "both"]) for i in range(n)]
    return spark.createDataFrame(rows, f"{', '.join(f'{c} string' for c in RECORD_COLUMNS)}, evidence_id string, warnings array<string>").withColumn("i", F.monotonically_increasing_id())


def test_merged_keeps_warnings_in_order_of_appearance(spark):
    rows = [(None, 3, ["b", "a"]), (None, 1, ["c", "b"]), ("x", 2, None), ("x", 0, [])]
    d = spark.createDataFrame(rows, "compound_id string, i long, warnings array<string>").select(*[F.col("compound_id") if c == "compound_id" else F.lit("v").alias(c) for c in RECORD_COLUMNS], F.lit("e").alias("evidence_id"), "i", "warnings")
    got = {r.compound_id: (r.i, r.warnings, r.duplicate_count) for r in dedup.merged(d, ["i"]).collect()}
    assert got == {None: (1, ["c", "b", "a"], 2), "x": (0, [], 2)}


def test_merged_predictions_and_sidecars(spark, tmp_path):
    m = dedup.merged(records(spark), ["i"])
    ev = spark.createDataFrame([("e0", "text"), ("e0", "again")], "evidence_id string, evidence_text string")
    writers.write_merged(m, ev, str(tmp_path), RECORD_COLUMNS)
    assert readers.read_predictions(spark, f"{tmp_path}/predictions.csv/*.csv", RECORD_COLUMNS).count() == 2
    side = {r.evidence_id: r.merged_evidence for r in spark.read.json(f"{tmp_path}/predictions_with_evidence.json").collect()}
    assert [x.evidence_text for x in side["e0"]] == ["again", "text"] and side["e1"] is None
    report = spark.read.json(f"{tmp_path}/dedup_report.json").first()
    assert (report.input_records, report.output_records, report.exact_duplicates_merged) == (3, 2, 1)


def test_metrics_summary_and_harness(spark, tmp_path):
    p = spark.createDataFrame([("a", "1"), ("a", "2")], "k string, v string")
    m = evaluate.field_metrics(p, p.where("v = '1'"), {"v": F.col("v")})
    writers.write_metrics(m, evaluate.summary(m), str(tmp_path))
    assert readers.read_strings(spark, f"{tmp_path}/field_metrics.csv").first().field == "v" and spark.read.json(f"{tmp_path}/metrics.json").count() == 1
    art = spark.createDataFrame([("a.pdf", "ok", 4, 3, 0.5), ("b.pdf", "error", 0, 0, None)], "source_file string, status string, responses long, valid_responses long, macro_f1 double")
    r = diagnose.harness_report(art)
    writers.write_harness(art, r, str(tmp_path))
    writers.write_summary(art, {"domain": "assays"}, str(tmp_path))
    got = spark.read.json(f"{tmp_path}/harness_report.json").first()
    assert (got.articles, got.ok, got.responses, got.valid_responses, got.valid_json_ratio, got.macro_f1) == (2, 1, 4, 3, 0.75, 0.5)
    assert readers.read_strings(spark, f"{tmp_path}/harness_summary.csv").count() == 2 and spark.read.json(f"{tmp_path}/run_manifest.json").first().value == "assays"


def test_missing_files_review_rows_and_evidence(spark, tmp_path):
    a, b = (spark.createDataFrame([(x,) for x in xs], "name string") for xs in (["a", "b", "c"], ["b", "z"]))
    writers.write_missing(diagnose.inventory(a, b, "name"), f"{tmp_path}/missing.csv")
    assert sorted(r.name for r in readers.read_strings(spark, f"{tmp_path}/missing.csv").collect()) == ["a", "c"]
    for i in range(2):
        (tmp_path / f"run{i}").mkdir()
        (tmp_path / f"run{i}" / "review_records.json").write_text(json.dumps({"pdf": f"{i}.pdf", "page": i}) + "\n")
    got = readers.read_review_rows(spark, f"{tmp_path}/run*/review_records.json")
    assert sorted((r.pdf, r.page) for r in got.collect()) == [("0.pdf", "0"), ("1.pdf", "1")] and set(dict(got.dtypes).values()) == {"string"}
    e = spark.createDataFrame([("a", 0, 1, 0, "second"), ("a", 0, 0, 0, "first")], "source_file string, part int, ord1 int, ord2 int, text string")
    writers.write_evidence(e, f"{tmp_path}/evidence.json")
    assert [r.text for r in spark.read.json(f"{tmp_path}/evidence.json").orderBy("ord1").collect()] == ["first", "second"]


def test_gold_data_is_refused_by_the_readers(spark, tmp_path):
    with pytest.raises(ValueError, match="ground truth"):
        readers.read_parsed(spark, f"{tmp_path}/ground_truth.csv")
    with pytest.raises(ValueError, match="ground truth"):
        readers.read_pdfs(spark, f"{tmp_path}/metrics.json")


def test_a_bad_file_fails_alone_or_ends_the_job(spark):
    files = spark.createDataFrame([("x/a.pdf", b"1"), ("x/b.pdf", b"")], "path string, content binary")

    def parser(name, data):
        if not data:
            raise OSError("empty")
        return {"source_file": name, "page_count": 1, "metadata": {}, "text_blocks": [], "tables": []}

    assert {r.source_file: (r.status, r.error) for r in readers.parse_files(files, parser).collect()} == {"a.pdf": ("ok", ""), "b.pdf": ("failed", "OSError: empty")}
    with pytest.raises(Exception, match="empty"):
        readers.parse_files(files, parser, fail_fast=True).collect()


def test_replay_files():
    assert replay.replay_file("r/", "x/My paper.PDF") == "r/My paper.json" and replay.replay_file("r", "a\\b.pdf", ".raw.json") == "r/b.raw.json"
    assert replay.replay_file(None, "a.pdf") is None


def test_selection_prefers_the_audit_and_keeps_what_is_asked_for(spark):
    audit = spark.createDataFrame([("a", 0, "expected-zero")], "source_file string, rows long, row_bucket string")
    summary = spark.createDataFrame([("a", 0), ("b", 0), ("c", 3), ("d", 9)], "source_file string, rows long")
    pick = lambda *x, **k: sorted((r.source_file, r.row_bucket) for r in diagnose.selected(*x, **k).collect())
    assert pick(audit, summary) == [("b", "zero-row"), ("c", "low-row")] and pick(None, summary)[0] == ("a", "zero-row")
    assert pick(audit, summary, include=summary.where("source_file in ('a', 'd')")) == [("a", "expected-zero"), ("d", "ok")]
