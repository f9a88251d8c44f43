"""Artifacts of every form written and read again, and answers judged item by item."""

import json

import pytest
from pyspark.sql import functions as F

from lodestream.functions import json as J
from lodestream.functions import text as T
from lodestream.operators import replay
from lodestream.operators.evidence import PARSED
from lodestream.sources import artifacts, readers, writers

ROWS = [{"pdf": f"{i}.pdf", "page": i, "note": None, "ok": i == 1, "share": 0.5, "whole": 4.0} for i in range(3)]


def documents(spark, n):
    rows = [(f"{i}.pdf", 1, {"k": "v"}, [("text é\nmore", None)], []) for i in range(n)]
    return spark.createDataFrame(rows, "source_file string, page_count int, metadata map<string,string>, text_blocks array<struct<text:string,source:string>>, tables array<string>").select(
        "source_file", "page_count", "metadata", F.transform("text_blocks", lambda b: F.struct(b["text"].alias("text"), F.struct(F.col("source_file"), F.lit(1).alias("page"), F.lit(0.9).alias("confidence")).alias("source"))).alias("text_blocks"), F.lit("[]").alias("t")
    ).withColumn("tables", F.from_json("t", "array<struct<table_id:string>>")).drop("t")


def test_parsed_documents_come_back_whole(spark, tmp_path):
    writers.write_parsed(documents(spark, 10).repartition(2), f"{tmp_path}/lines")
    got = readers.read_parsed(spark, f"{tmp_path}/lines").orderBy("source_file").collect()
    assert [x.source_file for x in got] == [f"{i}.pdf" for i in range(10)] and got[3].text_blocks[0].text == "text é\nmore" and got[3].text_blocks[0].source.page == 1 and got[3].tables == []
    one = json.loads(documents(spark, 1).toJSON().first())
    for name, value in (("object.json", one), ("array.json", [one, one])):
        (tmp_path / name).write_text(json.dumps(value, indent=2, ensure_ascii=False), encoding="utf-8")
    assert readers.read_parsed(spark, f"{tmp_path}/*.json").count() == 3
    (tmp_path / "broken.json").write_text('{"source_file": "x",\n "page')
    with pytest.raises(Exception, match="not JSON"):
        readers.read_parsed(spark, f"{tmp_path}/*.json").collect()
    assert readers.read_parsed(spark, f"{tmp_path}/*.json", "drop").count() == 3
    kept = readers.read_parsed(spark, f"{tmp_path}/*.json", "keep").where("error is not null").collect()
    assert [(x.path.rsplit("/", 1)[-1], x.error) for x in kept] == [("broken.json", "not JSON")]
    assert set(readers.read_parsed(spark, f"{tmp_path}/lines").columns) == set(spark.createDataFrame([], PARSED).columns)


def test_review_rows_of_every_form(spark, tmp_path):
    forms = {"a [1]": json.dumps(ROWS, indent=2), "b": json.dumps(ROWS), "c d": "\n".join(map(json.dumps, ROWS)), "e": json.dumps(ROWS[0], indent=1), "f": "[1, null, \"x\"]", "g": "", "h": "[]", "i": "no json\nat all", "j": '"just\\n text"'}
    for name, text in forms.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "review_records.json").write_text(text)
    got = readers.read_review_rows(spark, f"{tmp_path}/*/review_records.json")
    assert got.columns == ["note", "ok", "page", "pdf", "share", "whole"]
    assert sorted(tuple(x) for x in got.collect()) == sorted([("", str(i == 1), str(i), f"{i}.pdf", "0.5", "4") for i in range(3)] * 3 + [("", "False", "0", "0.pdf", "0.5", "4")])
    some = readers.read_review_rows(spark, f"{tmp_path}/*/review_records.json", ("pdf", "absent"))
    assert some.columns == ["pdf", "absent"] and some.where("absent = ''").count() == 10
    d = artifacts.read_artifacts(spark, f"{tmp_path}/*/review_records.json").withColumn("run", F.regexp_extract("path", "([^/]+)/review_records", 1))
    errors = sorted((x.run, x.error) for x in d.where("error is not null").collect())
    assert errors == [("i", "not JSON")]
    order = [x.i for x in d.where("run = 'b'").orderBy("item_index").select(F.try_variant_get("item", "$.page", "int").alias("i")).collect()]
    assert order == [0, 1, 2]


def test_forms_columns_and_bad_lines(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1, "b": 2}\n\n{"a": 1} trailing\n{"b": 2, "a": 3}\n{"a": 1, "c": 2}\n')
    d = artifacts.read_artifacts(spark, str(tmp_path), columns=["a", "b"]).orderBy("item_index").collect()
    assert [x.error for x in d] == [None, "not JSON", None, "columns differ: extra c; missing b"]
    lines = artifacts.read_artifacts(spark, str(tmp_path), "lines")
    assert lines.count() == 4 and lines.where("error = 'not JSON'").count() == 1
    assert [x.error for x in artifacts.read_artifacts(spark, str(tmp_path), "whole").collect()] == ["not JSON"]
    typed = artifacts.typed(lines, "a int, b string", "keep").orderBy("item_index").collect()
    assert [(x.a, x.b, x.error) for x in typed] == [(1, "2", None), (None, None, "not JSON"), (3, "2", None), (1, None, None)]
    with pytest.raises(ValueError, match="form"):
        artifacts.read_artifacts(spark, str(tmp_path), "other")


def test_artifacts_as_a_stream(spark, tmp_path):
    (tmp_path / "in" / "r1").mkdir(parents=True)
    (tmp_path / "in" / "r1" / "review.json").write_text(json.dumps(ROWS, indent=2))

    def run():
        q = artifacts.stream_artifacts(spark, f"{tmp_path}/in").select("path", "item_index", F.to_json("item").alias("item"), "error").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out")

    assert run().count() == 3
    (tmp_path / "in" / "r2.json").write_text("[1")
    (tmp_path / "in" / "r3.json").write_text('{"pdf": "z"}')
    got = run()
    assert got.count() == 5 and got.where("error = 'not JSON'").count() == 1


def test_json_is_one_value_and_nothing_else(spark):
    good = ["1", " [1] ", '{"v": 1}', "null", '"a"', "[]", '"]}"']
    bad = ["", " ", "[1] x", "1 2", "5] [6", '5} {"z":6', '5, "w": 6', "5, 6", "{", "[1,]", '{"a": 1, "a": 2}', "x", None, '{"a": 1}\n{"a": 2}']
    got = spark.createDataFrame([(x,) for x in good + bad], "r string").select("r", J.strict(F.col("r")).isNotNull().alias("ok"), F.coalesce(J.kind(J.strict(F.col("r"))), F.lit("")).alias("k")).collect()
    assert {x.r: x.ok for x in got} == {x: True for x in good} | {x: False for x in bad}
    assert [x.k for x in got][: len(good)] == ["BIGINT", "ARRAY", "OBJECT", "VOID", "STRING", "ARRAY", "STRING"]


def answers(spark, *values):
    return spark.createDataFrame([(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "doc int, response string")


def test_lenient_answers_keep_what_is_good(spark):
    mixed = [{"compound_id": "a"}, 5, {"compound_id": "b", "target_value": 4.0}, None, {"compound_id": ["x"]}, {"target_type": "pMIC", "target_relation": "~"}, {"odd": 1}, {"target_value": True, "warnings": ["w"]}, {"target_value": 1.50}, {"smiles": None}, [], {}]
    d = replay.parse_lenient(answers(spark, mixed, {"records": mixed}, {"records": None}, {"other": []}, "[1] and more", "[]"))
    assert d.columns == ["doc", "response", "item_index", "item", "warning", "item_warnings"]
    got = d.orderBy("doc", "item_index").collect()
    for doc in (0, 1):
        mine = [x for x in got if x.doc == doc]
        assert [x.item_index for x in mine] == list(range(len(mixed)))
        assert [x.warning for x in mine] == [
            None, "record 1: not an object", None, "record 3: not an object", "record 4: compound_id: not a text", "record 5: target_relation: none of =, <, >, NOT_DETECTED", "record 6: odd: no such field",
            None, None, "record 9: smiles: not a text", "record 10: not an object", None,
        ]
        assert [(x.item.compound_id, x.item.target_value, x.item_warnings) for x in mine if x.item] == [("a", None, []), ("b", "4", ["target_relation_missing"]), (None, "True", ["w", "target_relation_missing"]), (None, "1.5", ["target_relation_missing"]), (None, None, [])]
    assert [(x.doc, x.warning) for x in got if x.doc > 1] == [(2, "LLM response must be a JSON array."), (3, "LLM response must be a JSON array."), (4, "Invalid JSON response")]


def test_strict_answers_are_taken_whole_or_not(spark):
    cases = [([{"target_value": "3"}], "is 3", True), ([{"target_value": "3", "extra": [1]}], "is 3", True), ([{"target_value": "3", "smiles": 5}], "is 3", False), ([{"target_value": "3"}, 7], "is 3", False), ([{}], "is NOT_DETECTED", True), ([{}], "is 3", False),
             ([{"target_value": None}], "NOT_DETECTED", False), ([], "x", True), ({"records": []}, "x", False), ("[] and", "x", False), ([{"target_value": ""}], "x", False), (None, "x", False)]
    d = spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r), t) for i, (r, t, _) in enumerate(cases)] + [(99, None, "x")], "i int, response string, text string")
    got = {x.i: x.valid for x in replay.parse_strict(d).collect()}
    assert got == {i: ok for i, (_, _, ok) in enumerate(cases)} | {99: False}


def test_batches_take_payloads_that_can_be_read(spark):
    item = {"compound_id": "a", "target_type": "MIC", "target_relation": "=", "target_value": 7, "target_units": "mM", "bacteria": "x", "smiles": "NOT_DETECTED", "evidence_id": "e"}
    a = spark.createDataFrame([(0, json.dumps([item, 5, None, item | {"target_value": "8"}])), (1, "broken"), (2, "[]"), (3, json.dumps({"records": [item]}))], "batch int, payload string")
    records = spark.createDataFrame([(b, *["v"] * 8) for b in (1, 2)], "batch int, " + ", ".join(f"{c} string" for c in replay._FIELDS))
    ev = spark.createDataFrame([(b, "e", "value 7") for b in range(4)], "batch int, evidence_id string, source_text string")
    got = replay.run_batches(a, records, ev, ["batch"]).select("batch", "origin", "target_value").collect()
    assert sorted(map(tuple, got)) == [(0, "payload", "7"), (0, "payload", "8"), (1, "records", "v"), (3, "payload", "7")]


def test_lenient_numbers_never_overflow(spark):
    cases = {"99999999999": 99999999999, " 4.9 ": 4, "-3": -3, "1e3": 1000, "1e30": None, "9223372036854775807": 9223372036854775807, "nan": None, "inf": None, "x": None, "": None, "9" * 40: None}
    got = spark.createDataFrame([(k,) for k in cases], "s string").select("s", T.lenient_int(F.col("s")).alias("n"), T.lenient_int(F.col("s"), 5).alias("d")).collect()
    assert {x.s: x.n for x in got} == cases and all(x.d == (5 if x.n is None else x.n) for x in got)
