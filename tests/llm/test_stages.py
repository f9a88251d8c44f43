"""Every pipeline stage alone over odd rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

KINDS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, cls string, mix_rest string, batch string, key string"
LONG = "\n".join(f"Line number {i} of a long text speaks of matter {i * 7919 % 100_003} and of no other." for i in range(20_000))
GOOD = "The river rose in spring, and the old bridge was closed until the engineers had looked at it."
ITEM = " ".join(f"bench{i}" for i in range(30))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows(spark):
    base = [(100, None), (101, ""), (102, " \n "), (103, LONG), (104, GOOD), (104, GOOD), (105, GOOD), (None, GOOD), (None, None), (106, "Before it. " + ITEM + " After it."), (107, "a"), (107, "another text under the same id, of some words")]
    base += [(i, f"Good line {i} is here, with words of its own: {i * i}, {i * 31}.\nAnd another one follows it." if i % 2 else f"BUY {i}!!! $$$ NOW!!! {i} %%%\n!!!") for i in range(40)]
    return spark.createDataFrame([(i, t, None if (i or 0) % 5 == 0 else "en", None if (i or 0) % 7 == 0 else "src0", None if t is None else len(t), 1.0, "k", "c", "r", "b", "y") for i, t in base], KINDS)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_odd_rows(spark, sf, name):
    d = rows(spark).cache()
    got = dict(pipeline.STAGES)[name](spark, d, sf)
    plain = [c.split()[0] for c in KINDS.split(", ")]
    assert got.columns == plain + (["mix_domain", "mix_tokens", "mix_copies"] if name == "mix" else [])
    left = got.collect()
    ids = [r.doc_id for r in left]
    assert {r.key for r in left} == {"y"} and {r.batch for r in left} == {"b"}
    if name == "quality":
        assert 103 in ids and 100 not in ids and 101 not in ids and 102 not in ids
    if name == "near_dedup":
        assert ids.count(104) == 1 and 105 not in ids and ids.count(107) == 2 and ids.count(None) == 2 and {100, 101, 102, 103} <= set(ids)
    if name == "repeats":
        text = {(r.doc_id, r.text) for r in left}
        assert (104, GOOD) in text and 105 not in ids and (None, GOOD) in text and (103, LONG) in text and {100, 101} <= set(ids)
    if name == "decontaminate":
        assert 106 not in ids and len(ids) == d.count() - 1
    if name == "mix":
        assert not {100, 101, 102} & set(ids) and all(r.mix_tokens > 0 and r.mix_copies in (1, 2) for r in left)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_empty_tables(spark, sf, name):
    assert dict(pipeline.STAGES)[name](spark, rows(spark).where("false"), sf).collect() == []


def test_run_over_odd_rows_is_the_stages_one_after_the_other(spark, sf):
    rows(spark).write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in pipeline.STAGES:
        stage(spark, d, sf).write.mode("overwrite").parquet(f"{sf}/at-{name}")
        d = spark.read.parquet(f"{sf}/at-{name}")
    out = pipeline.run(spark, sf)
    assert sorted(map(str, out.collect())) == sorted(map(str, d.collect())) and out.count() > 0
    assert out.where(F.col("text").contains("bench7")).count() == 0
