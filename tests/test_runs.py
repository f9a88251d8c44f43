"""Saved runs: what is shown, as-of choice, comparison with a baseline."""

from pyspark.sql import functions as F

from lodestream.operators import runs


def test_stale_names_are_hidden(spark):
    names = ["assays_full", "assays_DEBUG_2", "x_rules_final", "synergy_try", "synergy_full", "other", "synergy_full_probe", None]
    d = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.x for r in d.select(runs.shown(F.col("n"), always=("Synergy_full",), hidden_prefix="synergy_").alias("x")).collect()]
    assert got == [True, False, False, False, True, True, False, False]


def test_latest_complete_run(spark):
    asked = spark.createDataFrame([("a", 10, "x"), ("b", 5, "x"), ("c", 5, "x"), (None, 9, "x")], "article_id string, asked_at int, run_name string")  # a clashing name stays beside the struct
    saved = [("a", 3, "r1", True, 0.1), ("a", 10, "r2", True, 0.2), ("a", 10, "r3", True, 0.3), ("a", 10, "r4", False, 0.9), ("a", 11, "r5", True, 0.9), ("b", 6, "r6", True, 0.5), ("b", None, "r7", True, 0.5), (None, 1, "r8", True, 0.5)]
    d = runs.latest(asked, spark.createDataFrame(saved, "article_id string, run_at int, run_name string, complete boolean, f double"))
    got = {r.article_id: r.run and (r.run.run_name, r.run.f) for r in d.collect()}
    assert got == {"a": ("r3", 0.3), "b": None, "c": None, None: None} and d.columns == ["article_id", "asked_at", "run_name", "run"]
    assert runs.latest(asked, spark.createDataFrame([], "article_id string, run_at int, run_name string, complete boolean, f double")).where("run is null").count() == 4


def test_against_a_baseline(spark):
    r = spark.range(1).select(runs.against(F.lit(0.5), 0.25).alias("a"), runs.against(F.lit(0.1), 0.25).alias("b"), runs.against(F.lit(0.1), 0.0).alias("c")).first()
    assert (r.a.improvement, r.a.multiplier, r.a.reached) == (0.25, 2.0, True) and not r.b.reached and r.c.multiplier == 0.0
