"""Evidence: which passages of a parsed document are worth reading, scored and made few.

A parsed document is one row: source_file, page_count, metadata, text_blocks, tables.
Every output carries explicit ordinals, since order decides ids and ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions import text as T
from lodestream.spec import TABLE_LIKE, DomainSpec

SRC = "source_file string, page int, section string, table_id string, figure_id string, row_index int, extraction_method string, confidence double"
PARSED = f"source_file string, page_count int, metadata map<string,string>, text_blocks array<struct<text:string,source:struct<{', '.join(x.replace(' ', ':', 1) for x in SRC.split(', '))}>>>, tables array<struct<table_id:string,rows:array<array<string>>,source:struct<{', '.join(x.replace(' ', ':', 1) for x in SRC.split(', '))}>>>"

_ORD = ("source_file", "part", "ord1", "ord2", "ord3")


def _cells(row: Column) -> Column:
    return F.array_join(F.filter(row, lambda c: c.isNotNull() & (c != "")), " | ")


def chunks(parsed: DataFrame, spec: DomainSpec, around: int = 300) -> DataFrame:
    """Table rows that match; whole blocks that look like tables; else text around each match."""
    t = parsed.select("source_file", F.posexplode("tables").alias("ord1", "t")).select("source_file", "ord1", F.col("t.source").alias("source"), F.posexplode("t.rows").alias("ord2", "row"))
    t = t.select("source_file", F.lit(0).alias("part"), "ord1", "ord2", F.lit(0).alias("ord3"), "source", _cells(F.col("row")).alias("text"), F.col("ord2").cast("string").alias("row_id"))
    t = t.where(F.col("text").rlike(spec.interesting))
    b = parsed.select("source_file", F.posexplode("text_blocks").alias("ord1", "b")).select("source_file", "ord1", F.col("b.source").alias("source"), F.coalesce("b.text", F.lit("")).alias("block"))
    whole = F.col("block").rlike(spec.promote)
    texts = F.when(whole, F.array("block")).otherwise(T.windows(F.col("block"), spec.interesting, around))
    b = b.select("source_file", "ord1", "source", whole.alias("whole"), F.posexplode(texts).alias("ord2", "text"))
    b = b.select("source_file", F.lit(1).alias("part"), "ord1", "ord2", F.lit(0).alias("ord3"), "source", "text", F.when(F.col("whole"), TABLE_LIKE).alias("row_id"))
    return t.unionByName(b)


def tagged(c: Column, spec: DomainSpec) -> Column:
    """Names of the terms that the text has, in the domain's order."""
    return F.array_compact(F.array(*[F.when(c.rlike(t.pattern), F.lit(t.name)) for t in spec.terms]))


def categories(terms: Column, spec: DomainSpec) -> Column:
    table = F.create_map(*[F.lit(x) for t in spec.terms for x in (t.name, t.category)])
    return F.transform(terms, lambda t: F.try_element_at(table, t))


def score(terms: Column, spec: DomainSpec) -> Column:
    weight = F.create_map(*[F.lit(x) for k, v in spec.weights.items() for x in (k, float(v))])
    return F.aggregate(categories(terms, spec), F.lit(0.0), lambda a, c: a + F.coalesce(F.try_element_at(weight, c), F.lit(spec.default_weight)))


def scored(df: DataFrame, spec: DomainSpec, text: str = "source_text") -> DataFrame:
    """Adds matched_terms, score and confidence; keeps what has a term of the gate's categories."""
    gate = F.lit(False)
    for t in spec.terms:
        if t.category in spec.gate:
            gate = gate | F.col(text).rlike(t.pattern)
    d = df.where(gate).withColumn("matched_terms", tagged(F.col(text), spec))  # only what passes is tagged
    s = score(F.col("matched_terms"), spec)
    return d.withColumn("score", s).withColumn("confidence", F.least(F.lit(0.95), F.lit(0.45) + F.col("score") / 10))


def select(parsed: DataFrame, spec: DomainSpec, around: int = 600) -> DataFrame:
    """Scored evidence: table rows under their header, and windows of text; exact repeats dropped."""
    t = parsed.select("source_file", F.posexplode("tables").alias("ord1", "t"))
    header = _cells(F.flatten(F.slice("t.rows", 1, 2)))
    t = t.select("source_file", "ord1", F.col("t.source").alias("source"), header.alias("header"), F.posexplode("t.rows").alias("ord2", "row"))
    under = F.when((F.col("header") != "") & (F.col("ord2") > 1), F.concat("header", F.lit("\n"), _cells(F.col("row")))).otherwise(_cells(F.col("row")))
    t = t.select("source_file", F.lit(0).alias("part"), "ord1", "ord2", F.lit(0).alias("ord3"), "source", under.alias("source_text"), F.col("ord2").cast("string").alias("row_id"))
    b = parsed.select("source_file", F.posexplode("text_blocks").alias("ord1", "b")).select("source_file", "ord1", F.col("b.source").alias("source"), T.strip(F.coalesce("b.text", F.lit(""))).alias("block")).where("block <> ''")
    hint = F.col("block").rlike(spec.section_hint) & (F.length("block") <= 3 * around)
    each = F.flatten(F.array(*[_raw_windows(F.col("block"), x.pattern, around) for x in spec.terms]))
    b = b.select("source_file", "ord1", "source", F.posexplode(F.when(hint, F.array("block")).otherwise(each)).alias("ord2", "source_text"))
    b = b.select("source_file", F.lit(1).alias("part"), "ord1", "ord2", F.lit(0).alias("ord3"), "source", "source_text", F.lit(None).cast("string").alias("row_id"))
    e = scored(t.unionByName(b), spec)
    e = e.select(*_ORD, F.col("source.page").alias("page"), F.col("source.section").alias("section"), F.col("source.table_id").alias("table_id"), "row_id", "source_text", "score", "matched_terms", "confidence")
    e = exact_first(e)
    n = F.row_number().over(Window.partitionBy("source_file").orderBy("part", "ord1", "ord2"))
    eid = F.when(F.col("part") == 0, F.concat(F.lit("table-"), n)).otherwise(F.concat_ws("-", F.lit("text"), F.col("ord1") + 1, F.col("ord2") + 1))
    return e.withColumn("evidence_id", eid).withColumn("extraction_method", F.lit(f"{spec.name}.evidence"))


def _raw_windows(c: Column, pattern: str, around: int) -> Column:
    """As T.windows, blank ones kept, since they count for the ids."""
    return F.transform(T.offsets(c, pattern), lambda o: T.strip(F.substring(c, F.greatest(o["start"] - around, F.lit(0)) + 1, o["end"] + around - F.greatest(o["start"] - around, F.lit(0)))))


def exact_first(e: DataFrame) -> DataFrame:
    """The first of those with one place and, but for white space, one text."""
    key = ["source_file", "page", "table_id", "row_id", T.collapse(F.col("source_text"))]
    return e.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy("part", "ord1", "ord2"))).where("rn = 1").drop("rn")


def fingerprint(c: Column) -> Column:
    """Sorted distinct number-like and domain tokens; without any the first 240 characters."""
    flat = F.trim(F.regexp_replace(F.lower(c), r"(?U)\W+", " "))
    got = T.ordered_distinct_text(F.regexp_extract_all(flat, F.lit(r"(?U)\b\d+[a-z]{0,3}\b|mic|pmic|aureus|coli"), F.lit(0)))
    return F.when(got != "", got).otherwise(F.substring(flat, 1, 240))


def rank_columns(spec: DomainSpec) -> dict[str, Column]:
    """Completeness, score, table bonus and length, by which evidence is ranked."""
    cat = categories(F.col("matched_terms"), spec)
    bonus = F.col("table_id").isNotNull().cast("int")
    full = sum((F.array_contains(cat, k).cast("int") for k in ("assay", "bacteria", "unit", "compound")), bonus)
    return {"complete": full, "bonus": bonus, "size": F.length("source_text")}


def _by_rank() -> list[Column]:
    return [F.desc("complete"), F.desc("score"), F.desc("bonus"), F.asc("size"), F.asc("part"), F.asc("ord1"), F.asc("ord2")]


def near_collapse(e: DataFrame, spec: DomainSpec) -> DataFrame:
    """The best of those with one place and one fingerprint; the first where several are best."""
    d = e.withColumns(rank_columns(spec)).withColumn("print", fingerprint(F.col("source_text")))
    w = Window.partitionBy("source_file", "page", "table_id", "row_id", "print").orderBy(*_by_rank())
    return d.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "print")


def within_budget(e: DataFrame, spec: DomainSpec, most: int | None) -> DataFrame:
    """At most `most` per document: table evidence by rank, then each page's best, then the rest by rank."""
    d = near_collapse(e, spec)
    if not most or most <= 0:
        return d.drop("complete", "bonus", "size")
    page_best = F.row_number().over(Window.partitionBy("source_file", "page").orderBy(*_by_rank()))
    d = d.withColumn("phase", F.when(F.col("table_id").isNotNull(), 0).when(page_best == 1, 1).otherwise(2))
    place = F.row_number().over(Window.partitionBy("source_file").orderBy("phase", *_by_rank()))
    return d.withColumn("place", place).where(F.col("place") <= most).drop("place", "phase", "complete", "bonus", "size")


def sliced(df: DataFrame, by: list[str], order: list, spec: str | None) -> DataFrame:
    """START:STOP of each group's rows, open ends and negative numbers included."""
    if not spec:
        return df
    start, colon, stop = spec.partition(":")
    if not colon:
        raise ValueError("a slice is START:STOP, as 0:10 or 10:20")
    w = Window.partitionBy(*by)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(*order)) - 1
    at = lambda s, d: d if not s else F.greatest(n + int(s), F.lit(0)) if int(s) < 0 else F.lit(int(s))
    return df.withColumn("slice_keep", (i >= at(start, F.lit(0))) & (i < at(stop, n))).where("slice_keep").drop("slice_keep")


def planned(df: DataFrame, spec: DomainSpec, by: str = "source_file", most: int = 40) -> DataFrame:
    """Chunks with a positive plan score, the best `most` per document; ids count all chunks."""
    # scores come before the numbers, so that texts nobody asks for aren't carried to them
    d = df.withColumn("matched_terms", F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p, _ in spec.plan_terms])))
    weight = F.create_map(*[F.lit(x) for n, _, w in spec.plan_terms for x in (n, float(w))])
    d = d.withColumn("score", F.aggregate("matched_terms", F.lit(0.0), lambda a, t: a + F.element_at(weight, t)))
    i = F.row_number().over(Window.partitionBy(by).orderBy("part", "ord1", "ord2")) - 1
    d = d.withColumn("evidence_id", F.format_string("ev_%04d", i)).where("score > 0")
    return d.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "evidence_id"))).where(F.col("rn") <= most).drop("rn")


def dois(parsed: DataFrame) -> DataFrame:
    """Each document's digital object identifiers, lower-cased, without trailing punctuation."""
    b = parsed.select("source_file", F.explode("text_blocks").alias("b"))
    found = b.select("source_file", F.explode(F.regexp_extract_all("b.text", F.lit(r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+"), F.lit(0))).alias("doi"))
    return found.select("source_file", F.lower(F.regexp_replace("doi", r"[.,;)\]]+$", "")).alias("doi")).distinct()
