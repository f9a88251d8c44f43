"""The channel of rejected rows: places, stored messages, counts that add up, and a share that ends a run."""

import json

import pytest
from pyspark.sql import functions as F

from lodestream.operators import failures, validate
from lodestream.spec import MISSING

RAW = "source_file string, n int, compound_id string, smiles string, target_type string, target_relation string, target_value string, target_units string, bacteria string, evidence_text string, fields string"


def raw(spark, *rows):
    return spark.createDataFrame([(f, n, c, MISSING, "MIC", "=", v, "µM", "E. coli", t, "clash") for f, n, c, v, t in rows], RAW)


ROWS = (("a", 0, "1", "many", "x"), ("a", 1, MISSING, "4", "MIC 4"), ("a", 2, "2", "4-8", "4-8"), (None, 0, "3", "7", "MIC 9"), (None, 1, "3", None, "MIC"), ("b", 0, "4", "1", "1"), ("b", 1, "4", "1", None))


def channel(spark, rows=ROWS):
    d = raw(spark, *rows)
    good, refused = failures.normalized(d, ["n"], ["source_file"])
    checked = validate.checked(good)
    said = checked.where("error is not null").select("source_file", F.concat(F.lit("record "), "record_index", F.lit(": "), "error").alias("message"))
    return d, good, checked.where("error is null"), refused, said


def test_rejects_of_both_stages_name_the_raw_row(spark):
    d, good, accepted, refused, said = channel(spark)
    more = spark.createDataFrame([("a", "record 7: gone"), ("a", "no place"), ("b", "record 1: empty evidence text"), ("z", "record 0: other file")], said.schema)
    rows = refused.unionByName(failures.rebuilt(good, said.unionByName(more), ["source_file"])).collect()
    got = sorted(((r.stage, r.source_file, r.raw_index, r.reason, tuple(r.categories)) for r in rows), key=repr)
    missing = "missing required evidence-backed values: compound_id"
    want = [
        ("normalise", "a", 0, failures.NOT_A_NUMBER, ("invalid target value",)), ("normalise", None, 1, failures.NOT_A_NUMBER, ("invalid target value",)),
        ("validate", "a", 1, missing, ("missing required field", "compound_id parsing problem")), ("validate", None, 0, "target_value is not supported by evidence text: 7", ("invalid target value",)),
        ("validate", "b", 1, "empty evidence text", ("unknown",)), ("validate", "b", 1, "empty evidence text", ("unknown",)),
        ("unmapped", "a", None, "gone", ("unknown",)), ("unmapped", "a", None, "no place", ("unknown",)), ("unmapped", "z", None, "other file", ("unknown",)),
    ]
    assert got == sorted(want, key=repr)
    raws = {(r.source_file, r.raw_index): json.loads(r.raw) for r in rows if r.raw}
    assert raws["a", 0]["target_value"] == "many" and raws["a", 1]["n"] == 1 and raws["a", 1]["fields"] == "clash"


def test_counts_add_up_and_end_a_run(spark):
    d, good, accepted, refused, said = channel(spark)
    b = failures.balance(d, accepted, refused.unionByName(failures.rebuilt(good, said, ["source_file"])), ["source_file"])
    assert {(r.source_file, r.raw_rows, r.accepted, r.rejected, r.adds_up) for r in b.collect()} == {("a", 3, 1, 2, True), (None, 2, 0, 2, True), ("b", 2, 1, 1, True)}
    failures.refuse_above(b, 0.8)
    with pytest.raises(failures.TooManyFailures, match="5 of 7"):
        failures.refuse_above(b, 0.5)


def test_no_rows(spark):
    d, good, accepted, refused, said = channel(spark, ())
    b = failures.balance(d, accepted, refused.unionByName(failures.rebuilt(good, said, ["source_file"])), ["source_file"])
    assert b.count() == 0
    failures.refuse_above(b, 0.0)
