"""Connected components: by alternating large and small stars, every step a written table; once
no more than ONE_TASK links are left, by union-find in a single task of bounded memory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import Stored


#: Some 100 MB of union-find state; more links are contracted by stars until there are as few or nothing changes.
ONE_TASK = 1_000_000


def _union_find(batches):
    b = [x for x in batches if x.num_rows]
    if not b:
        return
    u, v = (np.concatenate([x.column(i).to_numpy() for x in b]) for i in (0, 1))
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    up = np.arange(len(ids))
    a, c = ends[: len(u)], ends[len(u) :]
    while True:  # hook each root to the smallest root it meets, then halve the paths
        ra, rc = up[a], up[c]
        far = ra != rc
        if not far.any():
            break
        hi, lo = np.maximum(ra, rc)[far], np.minimum(ra, rc)[far]
        np.minimum.at(up, hi, lo)
        while not np.array_equal(nxt := up[up], up):
            up = nxt
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[up])], names=["u", "component"])


def _lowest(e: DataFrame) -> DataFrame:
    return e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_lowest(both), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _lowest(down)
    return down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v")


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: columns u, v. Returns u, component (its least member) of every node that has an edge to another."""
    now = Stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    was = _state(now.df)
    while was[0] > ONE_TASK:
        nxt = Stored(_small(_large(now.df).distinct()).distinct(), "cc")
        now.drop()
        now, state = nxt, _state(nxt.df)
        if state == was:
            break
        was = state
    if was[0] <= ONE_TASK:
        found = Stored(now.df.select("u", "v").coalesce(1).mapInArrow(_union_find, "u long, component long"), "cc")
        now.drop()
        return found.df
    return now.df.select("u", F.col("v").alias("component")).union(now.df.select("v", "v").distinct())
