"""Rule extraction of assay records: prose patterns, and tables rebuilt from their text layer.

Tables are read inside one row by array functions (a text's lines are cut at the headers), so
no chunk is shuffled; only the suppression of prose on pages that gave table rows joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions import text as T
from lodestream.spec import EC_STRAIN, HEADER_ORGANISMS, MISSING, MRSA_STRAIN, MSSA_STRAIN, SHORT_ORGANISMS, TABLE_LIKE, UNIT_TOKEN, DomainSpec, words

_UNIT = words(UNIT_TOKEN)
_NUM = r"^([<>])?(\d+(?:\.\d+)?)$"
_OUT = "array<struct<compound_id:string,target_relation:string,target_value:string,target_units:string,bacteria:string,row_id:string,evidence_text:string,extraction_method:string,confidence:double>>"


def unit_of(text: Column, value: Column | None = None) -> Column:
    """The unit beside the value (up to 30 characters after it, then before), else of a `(MIC, unit)`
    header, else the first unit there is, else missing."""
    found = []
    if value is not None:
        parts = F.filter(F.transform(F.split(value, "[-–]"), T.strip), lambda p: p != "")
        any_of = F.array_join(F.transform(parts, T.quote), "|")
        number = F.concat(F.lit(r"(?<![\d.])(?:"), any_of, F.lit(r")(?![\d.])"))
        for around in (F.concat(F.lit("(?iuUd)"), number, F.lit(r"\s*(.{0,30})")), F.concat(F.lit("(?iuUd)(.{0,30})"), number)):
            found.append(F.when(F.size(parts) > 0, T.first_match(T.extract(text, around, 1), _UNIT)))
    found += [T.first_match(text, words(rf"\(\s*MIC\s*[,;:]\s*({UNIT_TOKEN})\s*\)"), 1), T.first_match(text, _UNIT)]
    return F.coalesce(*[F.when(x != "", T.collapse(x)) for x in found], F.lit(MISSING))


def _record(compound: Column, relation: Column, value: Column, unit: Column, organism: Column, row_id: Column, evidence: Column, method: str, confidence: float) -> Column:
    rel = F.when(relation == "", "=").otherwise(F.coalesce(relation, F.lit("=")))
    return F.struct(compound.alias("compound_id"), rel.alias("target_relation"), value.alias("target_value"), unit.alias("target_units"), organism.alias("bacteria"), row_id.alias("row_id"), evidence.alias("evidence_text"), F.lit(method).alias("extraction_method"), F.lit(confidence).alias("confidence"))


def _cell_record(cell: Column, compound: Column, unit: Column, organism: Column, evidence: Column, method: str, confidence: float) -> Column:
    """A record of a cell that is a number alone; null of any other."""
    return F.when(cell.rlike(_NUM), _record(compound, F.regexp_extract(cell, _NUM, 1), F.regexp_extract(cell, _NUM, 2), unit, organism, compound, evidence, method, confidence))


def _full_lines(text: Column) -> Column:
    return F.filter(F.transform(T.lines(text), T.strip), lambda x: x != "")


def _tokens(line: Column) -> Column:
    return F.split(T.strip(line), r"(?U)\s+")


def _bound(d: DataFrame, name: str, **columns: Column) -> DataFrame:
    """Adds columns `name`_... that are worked out once: a generator stands between them and whatever reads them."""
    return d.select("*", F.inline(F.array(F.struct(*[c.alias(f"{name}_{n}") for n, c in columns.items()]))))


def context(title: Column, header: Column, line: Column) -> Column:
    """First line that speaks of MIC, the header and the row, as one evidence text."""
    return F.array_join(F.filter(F.array(T.strip(F.coalesce(title, F.lit(""))), header, line), lambda p: p != ""), "\n")


# What tables of each kind are known by ------------------------------------------
_CODED_ID, _CODED_ROW = r"(?U)\b[A-Z]{1,4}-\d{1,3}\b", words(r"^([A-Z]{1,4}-\d{1,3})\s+(.+)$")
_CODED_HEADER = (words(r"\bCompounds?\b"), words(r"\b(?:S\.?aureus|E\.?coli)\b"))
_SHORT_TITLE, _SHORT_CELL, _SHORT_HEADER = words(r"\bCompd\.?\s*no\b"), r"(?:[<>]?\d+(?:\.\d+)?|[–-])", ("Sa", "Ec")
_SHORT_ROW = words(rf"^(\d+[a-z])\s+({_SHORT_CELL}(?:\s+{_SHORT_CELL}){{3,}})$")
_PAIR_HEADER, _PAIR_END = "(?iuUd)" + r"\bMIC\s*\([^)]*\)\s*[cd].*?MRSA\s*MIC", r"(?mdU)^Novobiocin\b|^ND,\s*indicates"
_PAIR_ROW, _PAIR_NUMBER, _PAIR_ORGANISMS = r"(?mdU)^\s*(\d{1,3})\s+.+$", r"(?U)(?<![A-Za-z])([<>])?\s*(\d+(?:\.\d+)?)", ("MTCC 3160", "MRSA")
_LABELS, _LABELLED_ROW, _LABELLED_CODE = ("Antibacterial", "MSSA", "MRSA", "Entry", "Code"), r"(?miud)^\s*\d+\s+([1-4][a-z])\s+(.+)$", "(?i)^[1-4][a-z]$"
# end of the fixed values ----------------------------------------------------------------------


def _none_yet(before: str | None) -> Column:
    return F.lit(True) if before is None else F.coalesce(F.size(F.col(f"{before}_r")), F.lit(0)) == 0


def _next(d: DataFrame, name: str, before: str | None, live: Column, records: Column) -> DataFrame:
    """Adds `name`_r: the records of the kinds before where there are any, else these where they are looked for."""
    new = F.when(live, records.cast(_OUT))
    return _bound(d, name, r=new if before is None else F.when(_none_yet(before), new).otherwise(F.col(f"{before}_r")))


def _column_table(d: DataFrame, name: str, before: str | None, live: Column, table: dict[str, str], is_header: Callable[[Column], Column], row: str, shift: int, method: str) -> DataFrame:
    """Row lines under the header above them. The lines are cut at the headers, so a text of many tables is
    read once, and a header is carried to its rows without a state."""
    live = _none_yet(before) & live & (F.col("_page_unit") != MISSING)
    lines = F.col("_page_lines")
    d = _bound(d, f"{name}_heads", at=F.when(live, F.array_compact(F.transform(lines, lambda x, i: F.when(is_header(x), i)))))
    at = F.col(f"{name}_heads_at")
    named = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])

    def section(p: Column, k: Column) -> Column:
        header = _tokens(F.get(lines, p))
        places = F.filter(F.transform(header, lambda tok, i: F.struct(i.alias("i"), F.try_element_at(named, tok).alias("organism"))), lambda x: x["organism"].isNotNull())
        body = F.filter(F.slice(lines, p + 2, F.coalesce(F.get(at, k + 1), F.size(lines)) - p - 1), lambda x: x.rlike(row))
        cells = F.transform(body, lambda x: F.struct(x.alias("line"), F.regexp_extract(x, row, 1).alias("id"), _tokens(F.regexp_extract(x, row, 2)).alias("cells")))
        return F.struct(F.array_join(header, " ").alias("header"), places.alias("places"), cells.alias("rows"))

    d = _bound(d, f"{name}_sections", s=F.transform(at, section))

    def of_row(s: Column, r: Column) -> Column:
        return F.array_compact(F.transform(s["places"], lambda p: _cell_record(F.get(r["cells"], p["i"] - shift), r["id"], F.col("_page_unit"), p["organism"], context(F.col("_page_title"), s["header"], r["line"]), method, 0.85)))

    return _next(d, name, before, live, F.flatten(F.transform(F.col(f"{name}_sections_s"), lambda s: F.flatten(F.transform(s["rows"], lambda r: of_row(s, r))))))


def _pair_table(d: DataFrame, name: str, before: str, text: Column) -> DataFrame:
    """Two MIC columns, third and fourth from the end, between a labelled header and the footnotes."""
    live = _none_yet(before) & F.col("_kind_pair")
    d = _bound(d, f"{name}_body", t=F.when(live, F.substring(text, F.regexp_instr(text, F.lit(_PAIR_HEADER)), F.length(text))))
    body = F.col(f"{name}_body_t")
    d = _bound(d, f"{name}_end", at=F.regexp_instr(body, F.lit(_PAIR_END)))
    stop = F.col(f"{name}_end_at")
    d = _bound(d, f"{name}_cut", t=F.when(stop > 0, F.substring(body, F.lit(1), stop - 1)).otherwise(body))
    cut = F.col(f"{name}_cut_t")
    found = F.arrays_zip(*[F.regexp_extract_all(cut, F.lit(_PAIR_ROW), F.lit(g)).alias(n) for g, n in enumerate(("line", "id"))])

    def numbers(r: Column) -> Column:
        rel, val = (F.slice(F.regexp_extract_all(r["line"], F.lit(_PAIR_NUMBER), F.lit(g)), -4, 2).alias(n) for g, n in ((1, "rel"), (2, "val")))
        return F.struct(r["line"].alias("line"), r["id"].alias("id"), rel, val, F.regexp_count(r["line"], F.lit(_PAIR_NUMBER)).alias("n"))

    rows = F.filter(F.transform(found, numbers), lambda r: r["n"] >= 5)
    each = lambda r: F.array(*[_record(r["id"], F.get(r["rel"], F.lit(i)), F.get(r["val"], F.lit(i)), F.lit("µM"), F.lit(o), r["id"], r["line"], "assays.rules.pair_table", 0.85) for i, o in enumerate(_PAIR_ORGANISMS)])
    return _next(d, name, before, live, F.flatten(F.transform(rows, each)))


def _strains(cells: Column, places: tuple[int, int, int], compound: Column, evidence: Column, method: str, confidence: float) -> Column:
    named = zip((EC_STRAIN, MSSA_STRAIN, MRSA_STRAIN), places, strict=True)
    return F.array_compact(F.array(*[_cell_record(F.get(cells, F.lit(i)), compound, F.lit("mg/mL"), F.lit(o), evidence, method, confidence) for o, i in named]))


def _labelled_table(d: DataFrame, name: str, before: str, text: Column) -> DataFrame:
    """EC, MSSA and MRSA cells of a labelled table, laid out in rows or else one cell a line."""
    live = _none_yet(before) & F.col("_kind_labelled")
    found = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(_LABELLED_ROW), F.lit(g)).alias(n) for g, n in enumerate(("line", "id", "cells"))])
    rows = F.filter(F.transform(found, lambda r: F.struct(r["line"].alias("line"), r["id"].alias("id"), _tokens(r["cells"]).alias("cells"))), lambda r: F.size(r["cells"]) >= 5)
    d = _next(d, f"{name}_wide", before, live, F.flatten(F.transform(rows, lambda r: _strains(r["cells"], (0, 3, 4), r["id"], r["line"], "assays.rules.labelled_table", 0.85))))
    live = _none_yet(f"{name}_wide") & F.col("_kind_labelled")
    d = _bound(d, f"{name}_lines", x=F.when(live, F.transform(T.lines(text), T.strip)))
    lines = F.col(f"{name}_lines_x")
    d = _bound(d, f"{name}_entry", at=F.array_position(lines, "Entry").cast("int"))  # from 1; the first line below it has this index from 0
    entry = F.col(f"{name}_entry_at")
    codes = F.array_compact(F.transform(lines, lambda x, i: F.when((entry > 0) & (i >= entry + 12) & x.rlike(_LABELLED_CODE), F.struct(x.alias("id"), i.alias("i")))))
    tall = F.transform(codes, lambda s: _strains(F.slice(lines, s["i"] - 11, F.lit(12)), (11, 8, 7), s["id"], F.array_join(F.slice(lines, s["i"] - 11, F.lit(14)), "\n"), "assays.rules.labelled_table_vertical", 0.8))
    return _next(d, name, f"{name}_wide", live, F.flatten(tall))


def table_records(chunks: DataFrame, text: str = "text", out: str = "r") -> DataFrame:
    """The rows whose text holds a table, with `out`: the records of the first kind of table that gives any.

    Kinds are tried in turn, each on the texts that those before left without a record, and what more than one
    expression reads is bound once. A text stays in its row, so nothing is shuffled, and the work is linear in
    its lines. Null and empty texts hold no table; column names that begin with an underscore are used on the way."""
    c = F.col(text)
    turned = F.array_join(F.transform(T.lines(c), lambda x: F.reverse(x)), "\n")  # lines that were stored backwards
    d = _bound(chunks, "_upright", t=F.when(c.contains("edoC") & c.contains("yrtnE"), turned).otherwise(c))
    mic, t = c.contains("MIC"), F.col("_upright_t")
    labelled = F.lit(True)
    for label in _LABELS:
        labelled = labelled & t.contains(label)
    d = _bound(d, "_kind", coded=mic & c.rlike(_CODED_ID), short=mic & c.rlike(_SHORT_TITLE), pair=mic & c.rlike(_PAIR_HEADER), labelled=labelled)
    d = d.where("_kind_coded or _kind_short or _kind_pair or _kind_labelled")
    ruled = F.col("_kind_coded") | F.col("_kind_short")
    title = F.get(F.filter(T.lines(c), lambda x: x.contains("MIC")), F.lit(0))
    d = _bound(d, "_page", unit=F.when(ruled, unit_of(c)), lines=F.when(ruled, _full_lines(c)), title=F.when(ruled, title))
    of_codes = lambda x: x.rlike(_CODED_HEADER[0]) & x.rlike(_CODED_HEADER[1])
    d = _column_table(d, "_coded", None, F.col("_kind_coded"), HEADER_ORGANISMS, of_codes, _CODED_ROW, 1, "assays.rules.coded_table")
    of_short = lambda x: F.array_contains(_tokens(x), _SHORT_HEADER[0]) & F.array_contains(_tokens(x), _SHORT_HEADER[1])
    d = _column_table(d, "_short", "_coded", F.col("_kind_short"), SHORT_ORGANISMS, of_short, _SHORT_ROW, 0, "assays.rules.short_table")
    d = _labelled_table(_pair_table(d, "_pair", "_short", c), "_labelled", "_pair", t)
    return d.where(F.size("_labelled_r") > 0).select(*[F.col(f"`{n}`") for n in chunks.columns if n != out], F.col("_labelled_r").alias(out))


def prose_records(text: Column, spec: DomainSpec) -> Column:
    """Every assay mention with every organism mention (repeats kept) and the text's first compound."""
    groups = [F.regexp_extract_all(text, F.lit(spec.assay), F.lit(g)).alias(n) for g, n in ((1, "kind"), (2, "rel"), (3, "val"), (4, "unit"))]
    names = F.regexp_extract_all(text, F.lit(spec.entity), F.lit(1))
    names = F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(MISSING)))
    compound = F.coalesce(T.first_match(text, spec.compound, 1), F.lit(MISSING))

    def of(a: Column) -> Column:
        val = F.translate(a["val"], "– ", "-")
        rel = F.when(a["rel"].isin("<=", ">="), F.substring(a["rel"], 1, 1)).when(a["rel"] == "", "=").otherwise(a["rel"])
        unit = F.when(a["unit"] != "", a["unit"]).otherwise(unit_of(text, val))
        return F.transform(names, lambda n: F.struct(compound.alias("compound_id"), a["kind"].alias("target_type"), rel.alias("target_relation"), val.alias("target_value"), unit.alias("target_units"), n.alias("bacteria")))

    return F.flatten(F.transform(F.arrays_zip(*groups), of))


def suppress(chunks: DataFrame, by: DataFrame, keys: tuple[str, ...] = ("source_file", "page")) -> DataFrame:
    """Chunks of none of the pages in `by`; null pages are equal to each other."""
    other = by.select(*[F.col(k).alias(f"by_{k}") for k in keys]).distinct()
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"by_{k}"))
        on = same if on is None else on & same
    return chunks.join(other, on, "left_anti")


def extract(chunks: DataFrame, spec: DomainSpec) -> DataFrame:
    """Raw records with their evidence, in order: those of tables, then those of prose on other pages."""
    base = chunks.select("source_file", "part", "ord1", "ord2", "text", "row_id", F.col("source.page").alias("page"), F.col("source.section").alias("section"), F.col("source.table_id").alias("table_id"))
    t = table_records(base)
    tables = t.select("source_file", F.lit(0).alias("stage"), "part", "ord1", "ord2", F.posexplode("r").alias("ord3", "r"), "page", "section", F.coalesce("table_id", F.lit(TABLE_LIKE)).alias("table_id"))
    tables = tables.select(*tables.columns[:6], F.col("r.compound_id"), F.lit(MISSING).alias("smiles"), F.lit("MIC").alias("target_type"), "r.target_relation", "r.target_value", "r.target_units", "r.bacteria", "page", "section", "table_id", "r.row_id", "r.evidence_text", "r.extraction_method", "r.confidence")
    p = suppress(base, t).select("source_file", F.lit(1).alias("stage"), "part", "ord1", "ord2", F.posexplode(prose_records(F.col("text"), spec)).alias("ord3", "r"), "page", "section", "table_id", "row_id", "text")
    prose = p.select(
        *p.columns[:6], "r.compound_id", F.lit(MISSING).alias("smiles"), "r.target_type", "r.target_relation", "r.target_value", "r.target_units", "r.bacteria", "page", "section", "table_id", "row_id",
        F.col("text").alias("evidence_text"), F.lit("assays.rules.prose").alias("extraction_method"), F.when(F.col("row_id").isNotNull(), 0.75).otherwise(0.6).alias("confidence"),
    )
    return tables.unionByName(prose)


ORDER = ("stage", "part", "ord1", "ord2", "ord3")
