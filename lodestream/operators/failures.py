"""One channel for what any stage rejects: stage, document, the raw row's place, reason and the row itself as JSON.

Good rows go on with `raw_index`, their place among the raw rows of their document, so that a later stage's reject
still names the raw row; a stage's messages, stored as texts, are joined back by the place they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions import text as T
from lodestream.operators import diagnose, normalize, numbering, validate

NOT_A_NUMBER = "target_value must be a number, a numeric range, or NOT_DETECTED"
_PLACE = r"(?U)^record\s+(\d+):\s*"


def _rows(d: DataFrame, stage: Column, by: list[str], reason: Column, fields: Column, categories: Column, raw: Column) -> DataFrame:
    return d.select(stage.alias("stage"), *by, "raw_index", reason.alias("reason"), fields.alias("fields"), categories.alias("categories"), raw.alias("raw"))


def normalized(raw: DataFrame, order: list[str], by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Normalised rows with `raw_index` and `record_index` (from 0 among those that could be normalised), and the
    channel's rows for the others. Both read one written table; documents may have any number of rows."""
    numbered = numbering.running_index(raw, by, order, "raw_index")
    shown = F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw.columns]))
    d = normalize.record(numbered.withColumn("raw", shown)).withColumn("bad", ~F.coalesce(validate.value_is_number_or_range(F.col("target_value")), F.lit(False)))
    good = numbering.running_index(d.where("not bad").drop("bad"), by, ["raw_index"], "record_index")
    fields = F.array(F.lit("target_value"))
    kinds = diagnose.rejection_categories(F.lit(NOT_A_NUMBER), fields, F.array().cast("array<string>"))
    return good, _rows(d.where("bad"), F.lit("normalise"), by, F.lit(NOT_A_NUMBER), fields, kinds, F.col("raw"))


def rebuilt(good: DataFrame, messages: DataFrame, by: list[str]) -> DataFrame:
    """The channel's rows for stored messages (`by`, message: `record {i}: reason`, i among the normalised rows).

    A message that names no row, or one that isn't there, is a row without place, fields and raw row, of the
    category `unknown`. Each message gives one row, repeated ones too."""
    m = messages.select(*[F.col(c).alias(f"m_{c}") for c in by], "message").withColumn("place", F.regexp_extract("message", _PLACE, 1).try_cast("long"))
    g = good.select(*by, "record_index", "raw_index", "raw", validate.missing_fields().alias("missing"))
    on = m["place"] == g["record_index"]
    for c in by:
        on = on & m[f"m_{c}"].eqNullSafe(g[c])
    d = m.join(g, on, "left").drop(*by).withColumnsRenamed({f"m_{c}": c for c in by})
    reason, none = T.strip(F.regexp_replace("message", _PLACE, "")), F.array().cast("array<string>")
    d = d.withColumn("reason", reason).withColumn("fields", F.when(F.col("raw_index").isNotNull(), diagnose.rejection_fields(F.col("reason"))).otherwise(none))
    kinds = F.when(F.col("raw_index").isNotNull(), diagnose.rejection_categories(F.col("reason"), F.col("fields"), F.col("missing"))).otherwise(F.array(F.lit("unknown")))
    return _rows(d, F.when(F.col("raw_index").isNotNull(), "validate").otherwise("unmapped"), by, F.col("reason"), F.col("fields"), kinds, F.col("raw"))


def balance(raw: DataFrame, accepted: DataFrame, channel: DataFrame, by: list[str]) -> DataFrame:
    """Raw, accepted and rejected rows by document, and whether they add up. Messages that name no row count apart."""
    zero = F.lit(0).cast("long")
    parts = [(raw, F.lit(1), zero, zero, zero), (accepted, zero, F.lit(1), zero, zero), (channel, zero, zero, F.col("raw_index").isNotNull().cast("long"), F.col("raw_index").isNull().cast("long"))]
    names = ("raw_rows", "accepted", "rejected", "unmapped")
    sides = [d.select(*by, *[c.cast("long").alias(n) for c, n in zip(cols, names, strict=True)]) for d, *cols in parts]
    total = sides[0].unionByName(sides[1]).unionByName(sides[2]).groupBy(*by).agg(*[F.sum(n).alias(n) for n in names])
    return total.withColumn("adds_up", F.col("raw_rows") == F.col("accepted") + F.col("rejected"))


class TooManyFailures(RuntimeError):
    """More of the rows were rejected than a run may lose."""


def refuse_above(balanced: DataFrame, share: float) -> None:
    """Ends a run whose rejected share over all documents exceeds `share`; a run without rows goes on. One row reaches the driver."""
    n = balanced.agg(F.sum("raw_rows").alias("n"), F.sum("rejected").alias("bad")).first()
    if n.n and n.bad > share * n.n:
        raise TooManyFailures(f"{n.bad} of {n.n} rows were rejected, more than {share:.0%}")
