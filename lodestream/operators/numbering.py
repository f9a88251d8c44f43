"""Running numbers over tables of any size, with groups of any size: a distributed prefix sum.

The rows are dealt by ranges of (group, order), so that a group that holds most of them lies in many partitions, sorted there and
written with their places.  Of each group and partition only the first place and the number of rows are summed up, a row each,
and a window over these gives every partition its start.  No task sees a whole group, and nothing depends on
a partition being made twice alike, since the places are written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.sources import scratch


def _fresh(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def running_index(df: DataFrame, by: Sequence[str | Column], order: Sequence[str | Column], name: str = "row_index") -> DataFrame:
    """Adds `name`: the row's place (long, from 0) in its group by `order`, nulls first; without `by`, among all rows. A group
    of nulls is a group. Rows of one place in the order are numbered in some order that stays. A column of that name is replaced."""
    key, part, place = (_fresh(df, x) for x in ("group_key", "part_no", "place_no"))
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    d = scratch.written(df.drop(name).withColumn(key, group), "unnumbered")  # ranges are sampled from it, which must not make the rows twice
    d = d.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    d = scratch.written(d.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id()), "numbered")
    first, rows, start = (_fresh(d, x) for x in ("first_place", "n_rows", "start_no"))
    each = d.groupBy(key, part).agg(F.min(place).alias(first), F.count("*").alias(rows))
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a partition that has the group
    each = each.withColumn(start, F.coalesce(F.sum(rows).over(before), F.lit(0))).drop(rows)
    return d.join(each, [key, part]).withColumn(name, F.col(start) + F.col(place) - F.col(first)).drop(key, part, place, first, start)
