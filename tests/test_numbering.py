"""Running numbers against a sorted list, with a group that most rows are in."""

import random

import pytest
from pyspark.sql import functions as F

from lodestream.operators import dedup, numbering


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_running_index_matches_a_sorted_list(spark, parts):
    r = random.Random(parts)
    rows = [("hot" if r.random() < 0.7 else r.choice(["a", "b", None, "Z"]), r.randint(0, 50), None if i % 50 == 0 else i, "x") for i in range(3000)]
    d = spark.createDataFrame(rows, "g string, o int, i int, place_no string").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = numbering.running_index(d, ["g"], ["o", "i"], "n").collect()
        every = numbering.running_index(d, [], [F.desc("o"), "g", "i"], "n").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    low = lambda v: (v is not None, v if v is not None else 0)  # noqa: E731  nulls come first
    for g in {x[0] for x in rows}:
        mine = sorted((x for x in got if x.g == g), key=lambda x: x.n)
        assert [x.n for x in mine] == list(range(sum(x[0] == g for x in rows)))
        assert [(x.o, low(x.i)) for x in mine] == sorted((x.o, low(x.i)) for x in mine)
    every.sort(key=lambda x: x.n)
    assert [x.n for x in every] == list(range(len(rows))) and set(got[0].asDict()) == {"g", "o", "i", "place_no", "n"}
    assert [x.o for x in every] == sorted((x[1] for x in rows), reverse=True)


def test_numbers_of_an_empty_table_and_of_one_that_has_the_column(spark):
    d = spark.createDataFrame([], "g string, n string")
    assert numbering.running_index(d, ["g"], ["n"], "k").count() == 0
    one = spark.createDataFrame([("a", 5), ("a", 3)], "g string, k int")
    assert sorted(map(tuple, numbering.running_index(one.withColumn("o", F.col("k")), ["g"], ["o"], "k").collect())) == [("a", 3, 0), ("a", 5, 1)]


def test_rule_records_are_numbered_within_documents(spark):
    d = spark.createDataFrame([("a.pdf", 2), ("b.pdf", 1), ("a.pdf", 1)], "source_file string, i int")
    got = dedup.as_rule_records(d, ["i"], ["source_file"]).collect()
    assert sorted((x.source_file, x.i, x.evidence_id, x.warnings) for x in got) == [("a.pdf", 1, "rule-1", []), ("a.pdf", 2, "rule-2", []), ("b.pdf", 1, "rule-1", [])]
