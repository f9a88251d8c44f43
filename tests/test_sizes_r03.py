"""What the larger tables need: work over all cores, and cheap tests before dear ones that change no result."""

import json
import pathlib

import pytest
from pyspark.sql import functions as F

from lodestream.functions import json as json_
from lodestream.functions import text as T
from lodestream.operators import combination, validate
from lodestream.plans import rendered
from lodestream.sources import artifacts, readers, writers
from lodestream.spec import words


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Small tables of one row group each, as the driver's are."""
    at = str(tmp_path_factory.mktemp("tables"))
    spark.range(400).selectExpr("id AS p_partkey", "concat(' part ', id) AS p_name", "CAST(id % 50 + 1 AS INT) AS p_size").coalesce(1).write.parquet(f"{at}/part.parquet")
    spark.range(400).selectExpr("id AS o_orderkey", "id % 40 AS o_custkey").coalesce(1).write.parquet(f"{at}/orders.parquet")
    return at


def test_dictionary_tags_are_made_by_all_cores(spark, tables):
    parts = rendered.dictionary_tags(spark, tables).groupBy(F.spark_partition_id()).count().collect()
    assert sum(x["count"] for x in parts) == 400 and len(parts) >= spark.sparkContext.defaultParallelism


def test_folded_letters_are_those_that_patterns_take(spark):
    d = spark.range(0x110000).where("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    bad = d.selectExpr("c", f"{combination.folded('c')} AS l").where(" OR ".join(f"(c RLIKE '(?iuU){x}') <> contains(l, '{x}')" for x in "abcdefghijklmnopqrstuvwxyz"))
    assert bad.count() == 0


def test_needles_change_no_tag(spark):
    patterns = (*combination.PARTICLES, *combination.SPECIES, *combination.SHAPES)
    assert all(combination.needles(p) for p, _ in patterns)
    assert combination.needles(r"\brod[- ]?shaped\b|\brods?\b") == ["shaped", "rod"] and combination.needles(r"(?:a|b)c") == [] and combination.needles(r"\d+x") == []
    texts = ["Chİtoſan", "ROD-ſHAPED", "rodshaped", "Agnpſ", "xAgNP", "E.  coli", "E.COLİ", "a np.", "NPs", "nano cubes", "cube", "B.subtilis", "b", "", None, "hematite nanoparticle", "S. aureus", "Klebsiella pneumoniae"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for group in (combination.PARTICLES, combination.SPECIES, combination.SHAPES):
        plain, guarded = combination._first_of("t", group), combination._first_of("t", group, combination.folded("t"))
        assert d.where(f"NOT (({plain}) <=> ({guarded}))").count() == 0
    hours = d.select(F.expr(f"t RLIKE '{words('chitosan')}'").alias("x")).first().x
    assert hours  # the dotted capital counts as an i


FORMS = {
    "array": '[{"a": 1}, {"a": 2}]', "indented": '[\n {"a": 1},\n {"a": 2}\n]\n', "lines": '{"a": 1}\n\n{"a": 2}\r\n7\r"x"', "single": '{\n"a": 1\n}', "cut": '[\n {"a": 1},', "mixed": '{"a": 1}\nnot\n{"a": 2}', "empty": " \n", "none": "[]",
    "scalar": "5", "tall": '"just\\n text"\n', "numbers": "1\n2", "breaks": '{"a": "x\u2028y"}\n{"a": 2}', "spaces": '\u00a0\n{"a": 1}\n',
}


@pytest.fixture(scope="module")
def forms(tmp_path_factory):
    at = tmp_path_factory.mktemp("forms")
    for name, text in FORMS.items():
        (at / f"{name}.json").write_bytes(text.encode())
    return str(at)


def _rows(d):
    name = F.regexp_extract("path", r"(\w+)\.json", 1).alias("n")
    return sorted((r.n, r.item or "", r.error or "") for r in d.select(name, F.to_json("item").alias("item"), "error").collect())


def test_artifacts_of_every_form_are_one_scan(spark, forms):
    d = artifacts.read_artifacts(spark, forms)
    assert d._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    large = artifacts.read_artifacts(spark, forms, whole_bytes=0)
    assert large._jdf.queryExecution().optimizedPlan().toString().count("Relation [") > 1
    assert _rows(d) == _rows(large)
    one = json.dumps({"a": 1}, separators=(",", ":"))
    assert [x for x in _rows(d) if x[0] in ("cut", "scalar", "single", "none", "empty")] == [("cut", "", "not JSON"), ("scalar", "5", ""), ("single", one, "")]


def test_items_of_an_array_on_one_line_have_their_places(spark, forms):
    d = artifacts.read_artifacts(spark, f"{forms}/array.json").orderBy("item_index")
    assert [(x.item_index, x.a) for x in d.select("item_index", F.try_variant_get("item", "$.a", "int").alias("a")).collect()] == [(0, 1), (1, 2)]


def test_artifacts_are_written_by_all_cores(spark, tables):
    n = rendered._articles(spark, tables).groupBy(F.spark_partition_id()).count().count()
    assert n > 1 and rendered.artifact_items(spark, tables).where("error is null").count() == 242 and rendered.review_union(spark, tables).count() == 242


def test_review_rows_of_a_pattern_are_one_scan(spark, forms):
    d = readers.read_review_rows(spark, f"{forms}/*.json", ("a",))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert sorted(x.a for x in d.collect()) == sorted(["1", "2"] * 4 + ["1", "1", "x\u2028y", "2"])


def test_packed_files_are_read_as_the_files_are(spark, forms, tmp_path):
    files = spark.read.text(forms, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    writers.write_packed(files, f"{tmp_path}/packed")
    d = artifacts.read_artifacts(spark, f"{tmp_path}/packed", artifacts.PACKED)
    assert files.count() == len(FORMS) and _rows(d) == _rows(artifacts.read_artifacts(spark, forms))
    places = [sorted((x.path, x.item_index) for x in y.where("path LIKE '%/indented.json'").collect()) for y in (d, artifacts.read_artifacts(spark, forms))]
    assert [i for _, i in places[0]] == [0, 1] and places[0] == places[1]
    rows = [sorted(x.a for x in readers.read_review_rows(spark, p, ("a",), f).collect()) for p, f in ((f"{tmp_path}/packed", artifacts.PACKED), (forms, artifacts.AUTO))]
    assert len(rows[0]) == 12 and rows[0] == rows[1]
    wrong = [sorted(x.error or "" for x in artifacts.read_artifacts(spark, p, f, ["b"]).collect()) for p, f in ((f"{tmp_path}/packed", artifacts.PACKED), (forms, artifacts.AUTO))]
    assert any(x.startswith("columns differ") for x in wrong[0]) and wrong[0] == wrong[1]


def test_files_of_runs_grow_with_bytes_and_not_with_articles(spark, tables, tmp_path):
    spark.range(8000).selectExpr("id AS p_partkey", "concat(' part ', id) AS p_name", "CAST(id % 50 + 1 AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    files = [sum(x.is_file() and x.name.startswith("part-") for x in pathlib.Path(rendered._left_by_runs(spark, at).removeprefix("file:")).rglob("*")) for at in (tables, str(tmp_path))]
    assert max(files) <= 4 * spark.sparkContext.defaultParallelism + 1
    assert rendered.review_union(spark, str(tmp_path)).count() == 8000 // 4 * 2 + 50
    got = rendered.artifact_items(spark, str(tmp_path)).groupBy("article").agg(F.count("p_partkey").alias("n"), F.count("error").alias("e"))
    assert {x.article: (x.n, x.e) for x in got.collect()} == {a: ((40, 0), (40, 0), (1, 0), (0, 1))[a % 4] for a in range(200)}


def test_numbers_of_rows_own_patterns_are_made_only_where_the_text_has_them(spark):
    texts = ["4", "14", "4.", "a 4 b", "text", "", None, "x ", " \t", "4\\E5"]
    d = spark.createDataFrame([(t, p) for t in texts for p in ("4", "4\\E5", "", None)], "t string, p string")
    own = F.regexp_like("t", F.concat(F.lit(r"(?<![\d.])"), T.quote(F.col("p")), F.lit(r"(?![\d.])")))
    assert d.where(~T.has_number(F.col("t"), F.col("p")).eqNullSafe(own)).count() == 0
    assert d.where(~T.blank(F.col("t")).eqNullSafe(T.strip(F.col("t")) == "")).count() == 0
    plan = d.select(T.has_number(F.col("t"), F.col("p")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Contains(") < plan.index("RLIKE")


def test_white_space_is_what_unicode_says(spark):
    d = spark.range(0x110000).where("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    assert d.where(F.col("c").rlike(validate._SPACE) != F.col("c").rlike(r"(?U)\s")).count() == 0
    words_ = ["R1", "R", "xR2 ", "-R12)", "Ar", "-Ar-", "Aromatic", "CAr", "C*C", "NOT_DETECTED", "C C", "C(", "CC", "R١", "Ra", "_R", "éR", "", None]
    old = F.col("s").rlike(r"(?U)\*|(^|[^A-Za-z0-9])R\d*\b|(^|[^A-Za-z0-9])Ar\b")
    got = spark.createDataFrame([(w,) for w in words_], "s string").select(validate.structure_status(F.col("s")).alias("x"), old.alias("old")).where("x = 'generic_scaffold' AND NOT old OR x NOT IN ('generic_scaffold', 'not_applicable') AND old")
    assert got.count() == 0


def test_answers_items_are_judged_by_all_cores(spark, tables):
    d = rendered.answers_items(spark, tables)
    parts = d.groupBy(F.spark_partition_id()).count().collect()
    assert sum(x["count"] for x in parts) == 9 * 400 and len(parts) >= spark.sparkContext.defaultParallelism
    kinds = spark.createDataFrame([(x,) for x in ('{"a": [1]}', "[{}]", '"x<(_"', "1", "1.5", "1e400", "null", "true", "no")], "t string").select(json_.kind(F.try_parse_json("t")).alias("k"), F.regexp_extract(F.schema_of_variant(F.try_parse_json("t")), "^[A-Z]+", 0).alias("r"))
    assert kinds.where("NOT (k <=> r)").count() == 0
