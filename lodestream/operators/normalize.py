"""Normalisation of records: projections over the seven columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions import text as T
from lodestream.spec import AUREUS_KEYS, BACTERIA_ALIASES, COLI_KEYS, MISSING, UNIT_ALIASES


def unit(c: Column) -> Column:
    """White space goes, look-alike signs become one, known spellings one unit."""
    compact = F.translate(F.regexp_replace(c, r"(?U)\s+", ""), "μ−", "µ-")
    return F.when(c == MISSING, c).otherwise(T.mapped(compact, UNIT_ALIASES))


def bacteria(c: Column) -> Column:
    return F.when(c == MISSING, c).otherwise(T.mapped(T.strip(c), BACTERIA_ALIASES))


def _or_missing(c: Column) -> Column:
    t = T.strip(c)
    return F.when(t == "", MISSING).otherwise(t)


def record(raw: DataFrame) -> DataFrame:
    """Normalised copies of the seven columns; every other column, and `raw` itself, stays."""
    kind = F.when(F.upper("target_type") == "PMIC", "pMIC").otherwise("MIC")
    return raw.withColumns({
        "compound_id": _or_missing(F.col("compound_id")), "smiles": _or_missing(F.col("smiles")), "target_type": kind,
        "target_relation": F.when(F.col("target_relation").isin("=", "<", ">"), F.col("target_relation")).otherwise("="),
        "target_value": _or_missing(F.col("target_value")), "target_units": unit(F.col("target_units")), "bacteria": bacteria(F.col("bacteria")),
    })


def label(kind: Column, c: Column) -> Column:
    """Short labels of organisms; the potency type has its own."""
    t = T.strip(c)
    k = F.translate(F.lower(t), ". ", "")
    long = bacteria(t)
    return (
        F.when(t == MISSING, t)
        .when((kind == "pMIC") & k.isin(*COLI_KEYS), "EC").when((kind == "pMIC") & k.isin(*AUREUS_KEYS), "SA")
        .when(k.contains("n315") | (k == "mrsa"), "MRSA N315").when(k.contains("atcc29213"), "S. aureus ATCC 29213")
        .when(k.isin(*COLI_KEYS), "E. coli").when(k.isin(*AUREUS_KEYS), "S. aureus")
        .when(long == "Staphylococcus aureus", "S. aureus").when(long == "Escherichia coli", "E. coli").otherwise(long)
    )


def reported_unit(kind: Column, c: Column) -> Column:
    u = unit(c)
    return F.when((kind == "pMIC") & (u == MISSING), "µM").otherwise(u)


def value(c: Column) -> Column:
    """Each part of a range in plain notation; unchanged if any isn't a number."""
    parts = F.split(F.replace(c, F.lit(","), F.lit(".")), "-")
    ok = F.forall(parts, T.is_number)
    return F.when((c != MISSING) & ok, F.array_join(F.transform(parts, T.plain_decimal), "-")).otherwise(c)


def reported(df: DataFrame) -> DataFrame:
    """Values, units and labels as reported, with a warning for each change and `changed`."""
    d = df.withColumns({"new_value": value(F.col("target_value")), "new_units": reported_unit(F.col("target_type"), F.col("target_units")), "new_bacteria": label(F.col("target_type"), F.col("bacteria"))})
    arrow = lambda name, a, b: F.when(F.col(a) != F.col(b), F.concat(F.lit(f"{name}:"), a, F.lit("->"), b))
    notes = F.array_compact(F.array(F.when(F.col("target_value") != F.col("new_value"), F.lit("target_value_numeric_format_normalized")), arrow("target_units_normalized", "target_units", "new_units"), arrow("bacteria_normalized", "bacteria", "new_bacteria")))
    d = d.withColumn("changed", F.size(notes) > 0)
    d = d.withColumn("warnings", F.when(F.col("changed"), T.unique(F.concat(F.coalesce("warnings", F.array().cast("array<string>")), notes))).otherwise(F.coalesce("warnings", F.array().cast("array<string>"))))
    return d.withColumns({"target_value": F.col("new_value"), "target_units": F.col("new_units"), "bacteria": F.col("new_bacteria")}).drop("new_value", "new_units", "new_bacteria")


def coerced_value(c: Column) -> Column:
    """A value of any type as text: empty is missing, 4.0 is 4."""
    t = T.strip(c.cast("string"))
    whole = F.when(t.rlike(r"^-?\d+\.0+$"), F.regexp_replace(t, r"\.0+$", ""))
    return F.when(c.isNull() | (t == ""), MISSING).otherwise(F.coalesce(whole, t))
