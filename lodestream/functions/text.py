"""Scalar text functions as column expressions; all stay inside the JVM unless said otherwise."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lodestream.spec import MISSING

_EDGE = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(c, _EDGE, "")


def blank(c: Column) -> Column:
    """Whether strip() would leave nothing; it looks no further than the first character that is no white space."""
    return ~c.rlike(r"(?U)\S")


def clean(c: Column) -> Column:
    """A value as trimmed text; null is empty."""
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def ellipsis(c: Column, limit: int) -> Column:
    """Collapsed text, cut to `limit` characters with three dots."""
    t = collapse(c)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 3), F.lit("..."))).otherwise(t)


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match's group; null where nothing matches."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def extract(c: Column, pattern: Column, group: int = 0) -> Column:
    """regexp_extract with a pattern that may differ from row to row."""
    return F.call_function("regexp_extract", c, pattern, F.lit(group))


def quote(c: Column) -> Column:
    """A value as a literal pattern, row by row."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def offsets(c: Column, pattern: str) -> Column:
    """array<struct<start, end>> of all matches, from 0; the pattern must not match the empty string.

    Matches and the gaps between them alternate, so a running sum gives the places."""
    gaps, hits = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    step = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda m, g: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    init = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        return F.struct((s + x["m"]).alias("at"), F.array_append(acc["out"], F.struct(s.alias("start"), (s + x["m"]).alias("end"))).alias("out"))

    return F.when(c.isNotNull() & c.rlike(pattern), F.aggregate(step, init, add, lambda acc: acc["out"])).otherwise(empty)


def windows(c: Column, pattern: str, around: int) -> Column:
    """The text up to `around` characters before and after every match, trimmed; blank ones dropped."""
    cut = F.transform(offsets(c, pattern), lambda o: strip(F.substring(c, F.greatest(o["start"] - around, F.lit(0)) + 1, o["end"] + around - F.greatest(o["start"] - around, F.lit(0)))))
    return F.filter(cut, lambda w: w != "")


def mapped(c: Column, table: Mapping[str, str], otherwise: Column | None = None) -> Column:
    """A fixed lookup; values that aren't keys stay, or become `otherwise`."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, c), c if otherwise is None else otherwise)


def lines(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), r"\r\n|[\n\r\x0B\x0C\x1c-\x1e\x85  ]")


def unique(c: Column) -> Column:
    """Distinct items in order of first appearance."""
    return F.array_distinct(c)


def ordered_distinct_text(c: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(c)), " ")


_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def is_number(c: Column) -> Column:
    return F.trim(c).rlike(_NUMBER)


def plain_decimal(c: Column) -> Column:
    """Plain notation without trailing zeros (`5.0` is `5`, `1e3` is `1000`); what isn't a number stays.

    Up to 18 digits before and after the point; longer ones are left as they are."""
    t = F.trim(c)
    d = F.when(t.rlike(_NUMBER), t.try_cast("decimal(38,18)"))
    text = F.regexp_replace(F.regexp_replace(d.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    zero = F.when(text.isin("0", "-0"), F.when(t.startswith("-"), "-0").otherwise("0"))
    return F.coalesce(zero, text, c)


def comma_decimal(c: Column) -> Column:
    return plain_decimal(F.replace(c, F.lit(","), F.lit(".")))


def _six(v: str | None) -> str | None:
    if v is None:
        return None
    t = v.replace(",", ".").strip()
    try:
        return f"{float(t):.6g}"
    except ValueError:
        return t


@F.pandas_udf(StringType())
def six_digits(values: pd.Series) -> pd.Series:
    """Numbers to six significant digits (as `%.6g`), which no built-in writes; others unchanged."""
    return values.map(_six)


@F.pandas_udf(ArrayType(StringType()))
def all_six_digits(lists: pd.Series) -> pd.Series:
    """six_digits() of all values of an array."""
    return lists.map(lambda x: None if x is None else [_six(v) for v in x])


def has_number(text: Column, piece: Column) -> Column:
    """Whether the text holds the number with no digit or point beside it (so not at a sentence's end)."""
    # a pattern of each row's own is compiled for it, so only where the text has the piece at all
    return F.contains(text, piece) & F.regexp_like(text, F.concat(F.lit(r"(?<![\d.])"), quote(piece), F.lit(r"(?![\d.])")))


def missing(c: Column) -> Column:
    return c == MISSING


def file_stem(c: Column) -> Column:
    """The last path part, by slash or backslash, without its suffix."""
    return F.regexp_replace(F.regexp_replace(c, r"^.*[/\\]", ""), r"(?i)\.[a-z0-9]+$", "")


def safe_label(c: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(file_stem(c), r"[^A-Za-z0-9_.-]+", "_"), r"^[_.]+|[_.]+$", "")
    return F.when(t == "", "document").otherwise(t)


def lenient_int(c: Column, default: int | None = None) -> Column:
    """The whole part of a number's text as a long; what is no number, or none that fits, is `default`."""
    t = F.trim(c.cast("string"))
    return F.coalesce(t.try_cast("long"), F.when(~F.isnan(t.try_cast("double")), t.try_cast("double").try_cast("long")), F.lit(default).cast("long"))


def fixed(c: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", c.cast("double"))


def letter_between(c: Column, low: Column, high: Column) -> Column:
    return F.ascii(F.lower(c)).between(F.ascii(F.lower(low)), F.ascii(F.lower(high)))
