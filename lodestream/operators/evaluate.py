"""Evaluation against gold rows: multiset precision, recall and F1 by field, document and overall.

Both sides are counted by (group, field, value) first and only the counts are joined, so a
value with many rows costs one row on each side; blank equals blank and counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions import text as T
from lodestream.spec import EVAL_BACTERIA


def canonical(field: str, c: Column) -> Column:
    """A value of the first domain for comparison."""
    t = F.regexp_replace(T.strip(F.coalesce(c, F.lit(""))), "^'+|'+$", "")
    if field == "target_relation":
        return F.when(t.startswith("=="), F.regexp_replace(t, "^=+", "")).otherwise(t)
    if field == "target_value":
        return T.comma_decimal(t)
    if field == "bacteria":
        return T.mapped(F.lower(t), EVAL_BACTERIA, t)
    return t


def document_key(c: Column, prefix: bool = False, keep_case: bool = False) -> Column:
    """A file name as key: no `.pdf`, lower case; prefix: neither a number before an underscore."""
    t = F.regexp_replace(T.strip(F.coalesce(c, F.lit(""))), r"(?i)\.pdf$", "")
    t = t if keep_case else F.lower(t)
    return F.regexp_replace(t, r"^\d+_", "") if prefix else t


def scope(truth: DataFrame, name: str | None = None, ids: set[str] | DataFrame | None = None) -> DataFrame:
    """Gold rows of a document name if one is given, else of any id (a set, or a table with the column id), else all."""
    if name is not None:
        return truth.where(document_key(F.col("pdf")) == document_key(F.lit(name)))
    if ids is not None:
        table = ids if isinstance(ids, DataFrame) else truth.sparkSession.createDataFrame([(i,) for i in sorted(ids)], "id string")
        asked = table.select(F.lower(T.clean(F.col("id"))).alias("asked_id")).distinct()
        keyed = truth.withColumns({"by_pdf": F.lower(T.clean(F.col("pdf"))), "by_doi": F.lower(T.clean(F.col("doi")))})
        first = keyed.join(asked, F.col("by_pdf") == F.col("asked_id"), "left_semi")
        rest = keyed.join(asked, F.col("by_pdf").eqNullSafe(F.col("asked_id")), "left_anti").join(asked, F.col("by_doi") == F.col("asked_id"), "left_semi")
        return first.unionByName(rest).drop("by_pdf", "by_doi")
    return truth


def check_columns(df: DataFrame, columns: tuple[str, ...]) -> None:
    if tuple(df.columns) != tuple(columns):
        raise ValueError(f"columns must be {list(columns)}; there are {df.columns}")


def _counts(df: DataFrame, fields: Mapping[str, Column], by: list[str], name: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), c.alias("value")) for f, c in fields.items()])
    return df.select(*by, F.explode(pairs).alias("x")).groupBy(*by, F.col("x.field").alias("field"), F.col("x.value").alias("value")).agg(F.count("*").alias(name))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def field_metrics(pred: DataFrame, truth: DataFrame, fields: Mapping[str, Column], by: list[str] | None = None, groups: DataFrame | None = None) -> DataFrame:
    """precision, recall, f1, true_positive, predicted, gold of each field (and group; groups: all that must appear).

    fields: canonical expressions by field name, alike for both sides."""
    by = by or []
    p, t = _counts(pred, fields, by, "n_pred"), _counts(truth, fields, by, "n_gold")
    both = p.join(t, [*by, "field", "value"], "full").groupBy(*by, "field").agg(
        F.sum(F.least(F.coalesce("n_pred", F.lit(0)), F.coalesce("n_gold", F.lit(0)))).alias("true_positive"), F.sum(F.coalesce("n_pred", F.lit(0))).alias("predicted"), F.sum(F.coalesce("n_gold", F.lit(0))).alias("gold")
    )
    if groups is not None or not by:
        spark = pred.sparkSession
        frame = spark.range(1).drop("id") if groups is None else groups.select(*by).distinct()
        frame = frame.select("*", F.explode(F.array(*map(F.lit, fields))).alias("field"))
        both = frame.join(both, [*by, "field"], "left").fillna(0, ["true_positive", "predicted", "gold"])
    return _rated(both)


def _rated(d: DataFrame) -> DataFrame:
    pr, rc = _ratio(F.col("true_positive"), F.col("predicted")), _ratio(F.col("true_positive"), F.col("gold"))
    d = d.withColumns({"precision": pr, "recall": rc})
    return d.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def metrics_by_level(pred: DataFrame, truth: DataFrame, fields: Mapping[str, Column], by: list[str]) -> DataFrame:
    """field_metrics() of every group (level `group`) and over all groups (level `all`, `by` null) from one scan of either side.

    Counts are joined once; grouping sets carry them to both levels, and the lesser of two counts is taken at each
    level after its sums, since the least of sums isn't the sum of least ones. Level `all` has a row for every field."""
    p, t = _counts(pred, fields, by, "n_pred"), _counts(truth, fields, by, "n_gold")
    bags = p.join(t, [*by, "field", "value"], "full")
    # an empty bag of each field, so that both levels are there without any row
    bags = bags.select(*by, "field", "value", F.coalesce("n_pred", F.lit(0)).alias("n_pred"), F.coalesce("n_gold", F.lit(0)).alias("n_gold"), F.lit(True).alias("real"))
    none = pred.sparkSession.range(1).select(*[F.lit(None).cast(bags.schema[c].dataType).alias(c) for c in by], F.explode(F.array(*map(F.lit, fields))).alias("field"), F.lit(None).cast("string").alias("value"), F.lit(0).alias("n_pred"), F.lit(0).alias("n_gold"), F.lit(False).alias("real"))
    keyed = ["field", "value"]
    sums = [F.sum("n_pred").alias("n_pred"), F.sum("n_gold").alias("n_gold"), F.max("real").alias("real"), F.grouping(F.col(by[0])).alias("wide")]
    at = bags.unionByName(none).groupingSets([[F.col(c) for c in [*by, *keyed]], [F.col(c) for c in keyed]], *[F.col(c) for c in [*by, *keyed]]).agg(*sums).where("real or wide = 1")
    level = F.when(F.col("wide") == 1, "all").otherwise("group").alias("level")
    return _rated(at.groupBy(level, *by, "field").agg(F.sum(F.least("n_pred", "n_gold")).alias("true_positive"), F.sum("n_pred").alias("predicted"), F.sum("n_gold").alias("gold")))


def summary(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means of precision and recall, F1 of these means, and the mean F1."""
    d = metrics.groupBy(*(by or [])).agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))
    return d.withColumn("f1_of_means", _ratio(2 * F.col("macro_precision") * F.col("macro_recall"), F.col("macro_precision") + F.col("macro_recall")))


def worst_fields(metrics: DataFrame, by: list[str] | None = None, n: int = 3) -> DataFrame:
    """The n fields with the least F1 below one, joined by semicolons."""
    by = by or []
    rn = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("f1", "field"))
    low = metrics.where("f1 < 1").withColumn("rn", rn).where(F.col("rn") <= n)
    return low.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "field"))), lambda x: x["field"]), ";").alias("worst_fields"))


def set_recall(base: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many distinct keys there are, how many are also chosen, and their ratio."""
    b, c = base.select(*keys).distinct(), chosen.select(*keys).distinct()
    n = b.agg(F.count("*").alias("base"))
    m = b.join(c, keys, "left_semi").agg(F.count("*").alias("kept"))
    return n.join(m).withColumn("recall", F.when(F.col("base") > 0, F.col("kept") / F.col("base")))  # one row each


def valid_ratio(valid: Column, total: Column, least: float = 0.95) -> Column:
    """Whether the share of valid answers is above `least`; null without any."""
    return F.when(F.sum(total) > 0, F.sum(valid) / F.sum(total) > least)


def ready(*criteria: Column) -> Column:
    """Whether all are true; unknown counts as not."""
    out = F.lit(True)
    for c in criteria:
        out = out & F.coalesce(c, F.lit(False))
    return out
