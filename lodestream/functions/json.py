"""JSON texts as VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict(c: Column) -> Column:
    """A text that is one JSON value and nothing else, as VARIANT; null otherwise, and where an object names a field twice.

    The parser stops after a value, whatever follows; so the text is put where something must follow, in two ways that no other text fits both of."""
    within = F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}"))), "$.v", "variant")
    return F.when(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))).isNotNull(), within)


def kind(v: Column) -> Column:
    """What a VARIANT holds: OBJECT, ARRAY, STRING, BOOLEAN, VOID (a JSON null) or a type of numbers; null for none."""
    name = F.schema_of_variant(v)
    for end in "<(_ ":
        name = F.substring_index(name, end, 1)
    return name


def fields(v: Column) -> Column:
    """An object as a map; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def plain_text(v: Column) -> Column:
    """A value as text: whole numbers without a point, True and False as Python writes them, nested values as JSON; null and missing are null."""
    whole = F.try_variant_get(v, "$", "decimal(38,0)").cast("string")
    number = F.when(F.try_variant_get(v, "$", "double") == whole.cast("double"), whole)
    text = F.try_variant_get(v, "$", "string")
    return F.when(kind(v) == "BOOLEAN", F.initcap(text)).when(kind(v).isin("STRING", "OBJECT", "ARRAY"), text).otherwise(F.coalesce(number, text))
