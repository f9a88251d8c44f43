"""Names of a dictionary in a text, found word by word in a hash set, so that their number costs nothing per text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _literal(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def hits_sql(c: str, names: Sequence[str]) -> str:
    """SQL of the names (lower-cased) that the text in c has as whole words, whatever their case, in the order of names.

    The text is cut into words once and each is looked up; only texts with a hit are held against the names' order. Names are single words of
    letters, digits and underscores; a text cut is what `\\b` with Unicode classes bounds."""
    low = list(dict.fromkeys(n.lower() for n in names))
    if odd := [n for n in low if not n or not all(x.isalnum() or x == "_" for x in n)]:
        raise ValueError(f"not single words: {odd[:5]}")
    listed = ", ".join(map(_literal, low))
    found = f"filter(array_distinct(transform(regexp_extract_all({c}, '(?U)\\\\w+', 0), w -> lower(w))), w -> w IN ({listed}))"
    return f"element_at(transform(array({found}), f -> CASE WHEN size(f) > 1 THEN array_intersect(array({listed}), f) ELSE f END), 1)"


def hits(c: str, names: Sequence[str]) -> Column:
    return F.expr(hits_sql(c, names))
