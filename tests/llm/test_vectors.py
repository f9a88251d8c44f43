"""Nearest neighbours of odd tables."""

import numpy as np
from pyspark.sql import functions as F

from lodestream.llm import nndescent


def near(spark, rows, kind="double", is_query=None, k=3):
    d = spark.createDataFrame([(*r, "x", 1.0) for r in rows], f"vec_id long, embedding array<{kind}>, rank string, score double")  # clashing names
    got = nndescent.nearest(d, F.col("vec_id") % 2 == 0 if is_query is None else is_query, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect())


def test_one_row_none_and_no_queries(spark):
    assert near(spark, [(0, [1.0, 2.0])]) == [] and near(spark, []) == [] and near(spark, [(1, [1.0]), (3, [2.0])]) == []
    assert near(spark, [(0, None), (2, []), (4, [0.0])]) == []


def test_ties_copies_and_negative_ids(spark):
    rows = [(i, [1.0, 0.0]) for i in range(-4, 5)] + [(7, [2.0, 1.0]), (7, [9.0, 9.0]), (9, [-1.0, 0.0])]
    got = near(spark, rows)
    assert [x[1:] for x in got if x[0] == 0] == [(1, 7, 2.0), (2, -4, 1.0), (3, -3, 1.0)]  # of one id the least vector, ties to smaller ids
    assert [x[1:] for x in got if x[0] == -4] == [(1, 7, 2.0), (2, -3, 1.0), (3, -2, 1.0)]


def test_doubles_are_scored_as_they_are(spark):
    rows = [(0, [1.0, 1e-9]), (1, [1.0, 1.0]), (3, [1.0, 2.0]), (5, [1.0, 3.0]), (7, [0.5])]
    assert [(v, s) for _, _, v, s in near(spark, rows)] == [(5, 1 + 3e-9), (3, 1 + 2e-9), (1, 1 + 1e-9)]
    huge = near(spark, [(0, [1e150, 0.0]), (1, [1e150, 1.0]), (3, [2e150, 0.0])])
    assert [(v, s) for _, _, v, s in huge] == [(3, 2e150 * 1e150), (1, 1e150 * 1e150)]


def test_long_vectors(spark):
    x = np.random.default_rng(2).normal(size=(60, 3000)).astype(np.float32)
    got = near(spark, list(enumerate(x.tolist())), "float", k=5)
    d = x.astype(np.float64)
    for q in range(0, 60, 2):
        s = d @ d[q]
        s[q] = -np.inf
        assert [v for a, _, v, _ in got if a == q] == np.lexsort((np.arange(60), -s))[:5].tolist()


def recall(spark, x, k=20):
    """Share of the truly nearest among those found, and whether every score is exact, for each 20th vector."""
    d = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in nndescent.nearest(d, F.col("vec_id") % 20 == 0, k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, k + 1)) and np.allclose([m[2] for m in mine], s[[m[1] for m in mine]], rtol=1e-9)
        hits += len({m[1] for m in mine} & set(np.lexsort((np.arange(len(x)), -s))[:k].tolist()))
    return hits / (k * len(range(0, len(x), 20)))


def test_recall_whatever_the_lengths(spark):
    r = np.random.default_rng(7)
    unit = r.normal(size=(1200, 32))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    one_long, some_huge = unit.copy(), unit.copy()
    one_long[17] *= 1e5
    some_huge[::400] *= 1e140
    decades = unit * 10 ** r.uniform(-5, 5, size=(1200, 1))
    for x in (one_long, decades, some_huge):
        assert recall(spark, x) >= 0.9
