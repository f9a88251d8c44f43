"""Registered queries of the extraction and evaluation operators over the driver's tables, with DuckDB SQL.

The tables' prose holds no assay terms, so the operators run with a domain of its own
(DOCS: numbers, addresses, licence words), which is what a DomainSpec is for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions import text as T
from lodestream.operators import combination, dedup, diagnose, evaluate, evidence, failures, normalize, replay, rules, validate
from lodestream.plans.documents import parsed
from lodestream.sources import scratch
from lodestream.sources.readers import tolerant_json
from lodestream.spec import MISSING, UNIT_TOKEN, DomainSpec, Term

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DOCS = DomainSpec(
    name="docs",
    columns=(),
    interesting="[0-9]{2,}",
    terms=(
        Term("assay", "number", "[0-9]{2,}"), Term("assay", "address", r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"), Term("bacteria", "licence", "(?i)licen[sc]e|copyright"),
        Term("unit", "secret", "(?i)token|secret|password"), Term("compound", "mail", "[a-z0-9.]+@[a-z0-9.]+"), Term("table", "cells", " [|] "),
    ),
    weights={"assay": 3.0, "bacteria": 2.0, "unit": 1.5, "compound": 1.0, "section": 1.0, "table": 0.5},
    gate=("assay", "bacteria"),
    plan_terms=(("number", "[0-9]{2,}", 5.0), ("licence", "(?i)licen[sc]e|copyright", 3.0), ("cells", " [|] ", 2.0)),
)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(d: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt over all cores. A table of a few numbers is one row group, read by one task, however much is made of each row."""
    return d.repartition(4 * d.sparkSession.sparkContext.defaultParallelism, *keys)


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


_LINES = "l AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"


@_query(f"WITH {_LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, md5(line) AS line FROM l WHERE regexp_matches(line, '[0-9]{{2,}}')")
def evidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that the domain finds interesting: a text is a table of one column, whose matching rows are evidence."""
    d = _read(spark, sf_dir, "documents")
    rows = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.array(x))
    e = evidence.chunks(parsed(d, F.col("doc_id").cast("string"), [], rows), DOCS)
    return e.select(F.col("source_file").cast("long").alias("doc_id"), F.col("ord2").alias("line_no"), F.md5("text").alias("line"))


@_query(
    r"""
WITH m AS (SELECT doc_id, text, regexp_extract_all(text, '[0-9]{2,}') AS hits, regexp_split_to_array(text, '[0-9]{2,}') AS gaps FROM documents WHERE regexp_matches(text, '[0-9]{2,}')),
o AS (SELECT doc_id, text, unnest(range(1, len(hits) + 1)) AS i, hits, gaps FROM m),
s AS (SELECT doc_id, text, i, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS a, length(hits[i]) AS n FROM o),
w AS (SELECT doc_id, i, regexp_replace(substr(text, CAST(greatest(a - 30, 0) + 1 AS BIGINT), CAST(a + n + 30 - greatest(a - 30, 0) AS BIGINT)), '^\s+|\s+$', '', 'g') AS t FROM s)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS match_no, md5(t) AS excerpt FROM w WHERE t <> ''
"""
)
def evidence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty characters around every match; overlapping ones are kept."""
    d = _read(spark, sf_dir, "documents").where(F.col("text").rlike(DOCS.interesting))
    return d.select("doc_id", F.posexplode(T.windows(F.col("text"), DOCS.interesting, 30)).alias("match_no", "w")).select("doc_id", "match_no", F.md5("w").alias("excerpt"))


_TAGS = {
    "number": "regexp_matches({c}, '[0-9]{{2,}}')", "address": "regexp_matches({c}, '[0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}')", "licence": "regexp_matches({c}, '(?i)licen[sc]e|copyright')",
    "secret": "regexp_matches({c}, '(?i)token|secret|password')", "mail": "regexp_matches({c}, '[a-z0-9.]+@[a-z0-9.]+')", "cells": "contains({c}, ' | ')",
}
_WEIGHT = {"number": 3.0, "address": 3.0, "licence": 2.0, "secret": 1.5, "mail": 1.0, "cells": 0.5}
_TERMS_SQL = lambda c: "list_filter([" + ", ".join(f"CASE WHEN {v.format(c=c)} THEN '{k}' END" for k, v in _TAGS.items()) + "], lambda x: x IS NOT NULL)"
_SCORE_SQL = lambda c: " + ".join(f"CASE WHEN {v.format(c=c)} THEN {_WEIGHT[k]} ELSE 0 END" for k, v in _TAGS.items())
_GATE_SQL = lambda c: "(" + " OR ".join(_TAGS[k].format(c=c) for k in ("number", "address", "licence")) + ")"
_SCORED = f"s AS (SELECT doc_id, lang, source, line_no, line, array_to_string({_TERMS_SQL('line')}, ',') AS terms, CAST({_SCORE_SQL('line')} AS DOUBLE) AS score FROM l WHERE {_GATE_SQL('line')})"


@_query(f"WITH {_LINES}, {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id, line_no) AS rn FROM s) SELECT source, doc_id, CAST(line_no AS INTEGER) AS line_no, terms, round(score, 6) AS score, round(least(0.95, 0.45 + score / 10), 6) AS confidence FROM r WHERE rn <= 5")
def term_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best scored lines of each source."""
    d = evidence.scored(_lines(spark, sf_dir), DOCS, "line")
    top = d.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "doc_id", "line_no"))).where("rn <= 5")
    return top.select("source", "doc_id", "line_no", F.array_join("matched_terms", ",").alias("terms"), F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_score_topk(spark, sf_dir)


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored lines as evidence: a source is a document, a language its page, lines with cells are table evidence."""
    d = evidence.scored(_lines(spark, sf_dir).withColumnRenamed("line", "source_text"), DOCS)
    return d.select(
        F.col("source").alias("source_file"), F.lit(0).alias("part"), F.col("doc_id").alias("ord1"), F.col("line_no").alias("ord2"), F.col("lang").alias("page"),
        F.when(F.array_contains("matched_terms", "cells"), "t").alias("table_id"), F.lit(None).cast("string").alias("row_id"), "source_text", "score", "matched_terms", "confidence",
    )


_EV = f"""{_LINES}, {_SCORED},
e AS (SELECT source, lang, CASE WHEN contains(line, ' | ') THEN 't' END AS table_id, doc_id, line_no, line, score,
  CAST(regexp_matches(line, '[0-9]{{2,}}') AS INTEGER) + CAST(regexp_matches(line, '(?i)licen[sc]e|copyright') AS INTEGER) + CAST(regexp_matches(line, '(?i)token|secret|password') AS INTEGER) + CAST(regexp_matches(line, '[a-z0-9.]+@[a-z0-9.]+') AS INTEGER) + CAST(contains(line, ' | ') AS INTEGER) AS complete,
  CAST(contains(line, ' | ') AS INTEGER) AS bonus, length(line) AS size,
  trim(regexp_replace(lower(line), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+', ' ', 'g'), ' ') AS flat FROM s),
f AS (SELECT *, array_to_string(list_sort(list_distinct(regexp_extract_all(flat, '\\b[0-9]+[a-z]{{0,3}}\\b|mic|pmic|aureus|coli'))), ' ') AS hits FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY source, lang, table_id, CASE WHEN hits <> '' THEN hits ELSE substr(flat, 1, 240) END ORDER BY complete DESC, score DESC, bonus DESC, size, doc_id, line_no) AS rn FROM f)"""
_RANK = "complete DESC, score DESC, bonus DESC, size, doc_id, line_no"


@_query(
    f"WITH {_LINES}, {_SCORED}, k AS (SELECT source, lang, doc_id, line_no, row_number() OVER (PARTITION BY source, lang, contains(line, ' | '), trim(regexp_replace(line, '\\s+', ' ', 'g'), ' ') ORDER BY doc_id, line_no) AS rn FROM s)"
    " SELECT source, lang, doc_id, CAST(line_no AS INTEGER) AS line_no FROM k WHERE rn = 1"
)
def exact_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of lines with one place and one text."""
    return evidence.exact_first(_evidence(spark, sf_dir)).select(F.col("source_file").alias("source"), F.col("page").alias("lang"), F.col("ord1").alias("doc_id"), F.col("ord2").alias("line_no"))


@_query(f"WITH {_EV} SELECT source, lang, doc_id, CAST(line_no AS INTEGER) AS line_no, round(score, 6) AS score FROM n WHERE rn = 1")
def near_dup_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best line of each place and fingerprint."""
    d = evidence.near_collapse(_evidence(spark, sf_dir), DOCS)
    return d.select(F.col("source_file").alias("source"), F.col("page").alias("lang"), F.col("ord1").alias("doc_id"), F.col("ord2").alias("line_no"), F.round("score", 6).alias("score"))


@_query(
    f"WITH {_EV}, b AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY {_RANK}) AS pb FROM n WHERE rn = 1), h AS (SELECT *, CASE WHEN table_id IS NOT NULL THEN 0 WHEN pb = 1 THEN 1 ELSE 2 END AS phase FROM b),"
    f" o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY phase, {_RANK}) AS place FROM h) SELECT source, lang, doc_id, CAST(line_no AS INTEGER) AS line_no, round(score, 6) AS score FROM o WHERE place <= 12"
)
def budget_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve pieces of evidence a source: tables first, then each language's best, then by rank."""
    d = evidence.within_budget(_evidence(spark, sf_dir), DOCS, 12)
    return d.select(F.col("source_file").alias("source"), F.col("page").alias("lang"), F.col("ord1").alias("doc_id"), F.col("ord2").alias("line_no"), F.round("score", 6).alias("score"))


@_query(
    f"WITH {_LINES}, i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, line_no) - 1 AS i FROM l),"
    " p AS (SELECT source, doc_id, line_no, 'ev_' || lpad(CAST(i AS VARCHAR), CAST(greatest(4, length(CAST(i AS VARCHAR))) AS INTEGER), '0') AS evidence_id, CAST(CASE WHEN regexp_matches(line, '[0-9]{2,}') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(line, '(?i)licen[sc]e|copyright') THEN 3 ELSE 0 END + CASE WHEN contains(line, ' | ') THEN 2 ELSE 0 END AS DOUBLE) AS score FROM i),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, evidence_id) AS rn FROM p WHERE score > 0) SELECT source, doc_id, CAST(line_no AS INTEGER) AS line_no, evidence_id, score FROM r WHERE rn <= 40"
)
def planner_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty best planned lines of each source."""
    d = _lines(spark, sf_dir).select(F.col("source").alias("source_file"), F.lit(0).alias("part"), F.col("doc_id").alias("ord1"), F.col("line_no").alias("ord2"), F.col("line").alias("text"))
    return evidence.planned(d, DOCS).select(F.col("source_file").alias("source"), F.col("ord1").alias("doc_id"), F.col("ord2").alias("line_no"), "evidence_id", "score")


@_query(f"WITH {_LINES}, t AS (SELECT DISTINCT source, lang FROM l WHERE contains(line, ' | ')) SELECT l.source, l.lang, CAST(count(*) AS BIGINT) AS n_lines FROM l ANTI JOIN t ON l.source IS NOT DISTINCT FROM t.source AND l.lang IS NOT DISTINCT FROM t.lang GROUP BY l.source, l.lang")
def page_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages (source, language) that gave no table row."""
    d = _lines(spark, sf_dir)
    return rules.suppress(d, d.where(F.col("line").contains(" | ")), ("source", "lang")).groupBy("source", "lang").agg(F.count("*").alias("n_lines"))


_FAN = DomainSpec(name="fan", columns=(), assay="(license|copyright|token)[^0-9]{0,40}(<=|>=|<|>|=)?\\s*([0-9]+)\\s*(mm|um)?", entity="(the|der|les|los)", compound="([a-z]{9,})")


@_query()
def assay_entity_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each measure with every entity mention of its line and the line's first compound."""
    d = _lines(spark, sf_dir).select("doc_id", "line_no", F.posexplode(rules.prose_records(F.lower("line"), _FAN)).alias("record_no", "r"))
    return d.select("doc_id", "line_no", "record_no", F.md5("r.compound_id").alias("compound"), "r.target_type", "r.target_relation", F.length("r.target_value").alias("digits"), "r.target_units", "r.bacteria")


@_query(rf"SELECT doc_id, CASE WHEN regexp_matches(text, '(?i){UNIT_TOKEN}') THEN trim(regexp_replace(regexp_extract(text, '(?i){UNIT_TOKEN}'), '\s+', ' ', 'g'), ' ') ELSE 'NOT_DETECTED' END AS unit FROM documents")
def unit_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit that a text states; inside words too, as the rules have it."""
    return _read(spark, sf_dir, "documents").select("doc_id", rules.unit_of(F.col("text")).alias("unit"))


_SIGNAL_SQL = " OR ".join(f"contains(lower(c), '{s}')" for s in combination.SIGNALS)


@_query(
    rf"""
WITH p AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), '([.;]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS pieces FROM documents),
x AS (SELECT doc_id, pieces, unnest(range(1, len(pieces) + 1)) AS i FROM p),
c AS (SELECT doc_id, i, CASE WHEN i = 1 THEN pieces[i] ELSE trim(right(pieces[i - 1], 350) || ' ' || pieces[i], ' ') END AS c FROM x),
s AS (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n FROM c WHERE {_SIGNAL_SQL})
SELECT doc_id, CAST(n AS INTEGER) AS snippet_no, md5(c) AS snippet FROM s WHERE n < 80
"""
)
def snippets_with_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence pieces with the tail of the one before, where there is a signal."""
    d = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(combination.snippets(F.col("text"))).alias("snippet_no", "s"))
    return d.select("doc_id", "snippet_no", F.md5("s").alias("snippet"))


_B = r"(?:^|[^\p{L}\p{M}\p{Nd}\p{Pc}])"
_E = r"(?:$|[^\p{L}\p{M}\p{Nd}\p{Pc}])"


@_query(
    rf"SELECT doc_id, coalesce(CASE WHEN regexp_matches(lower(text), '{_B}fici?{_E}|fractional inhibitory') THEN 'FIC' WHEN regexp_matches(lower(text), '{_B}mbec{_E}') THEN 'MBEC' WHEN regexp_matches(lower(text), '{_B}mic{_E}|minimum inhibitory concentration') THEN 'MIC'"
    " WHEN contains(lower(text), 'viability') THEN 'viability (%)' WHEN contains(lower(text), 'zone') OR contains(lower(text), 'disc diffusion') OR contains(lower(text), 'disk diffusion') THEN 'disc_diffusion' WHEN contains(lower(text), 'inhibition') THEN 'ZOI' END, 'none') AS method,"
    rf" coalesce(CASE WHEN regexp_matches(text, '(?i){_B}(license|licensed){_E}') THEN 'licence' WHEN regexp_matches(text, '(?i){_B}(the|is){_E}') THEN 'english' WHEN regexp_matches(text, '(?i){_B}(der|die){_E}') THEN 'german' END, 'other') AS tag FROM documents"
)
def method_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first method of the cascade that a text speaks of, and the first dictionary tag."""
    tags = ((r"\b(?:license|licensed)\b", "licence"), (r"\b(?:the|is)\b", "english"), (r"\b(?:der|die)\b", "german"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.coalesce(combination.method("text"), F.lit("none")).alias("method"), F.coalesce(combination.tag_first("text", tags), F.lit("other")).alias("tag"))


@_query(
    r"""
SELECT o_orderkey, CASE WHEN contains(v, '.') THEN regexp_replace(regexp_replace(v, '(\.[0-9]*?)0+$', '\1'), '\.$', '') ELSE v END AS value, p AS unit
FROM (SELECT o_orderkey, printf('%.2f', o_totalprice) AS v, CASE o_orderpriority WHEN '1-URGENT' THEN 'µg/mL' WHEN '2-HIGH' THEN 'µM' ELSE regexp_replace(o_orderpriority, '\s+', '', 'g') END AS p FROM orders)
"""
)
def normalize_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in plain notation, units by alias."""
    p = F.when(F.col("o_orderpriority") == "1-URGENT", "ug / mL").when(F.col("o_orderpriority") == "2-HIGH", "u M").otherwise(F.col("o_orderpriority"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", normalize.value(F.format_string("%.2f", "o_totalprice")).alias("value"), normalize.unit(p).alias("unit"))


@_query(
    "SELECT n_nationkey, CASE k WHEN 0 THEN 'E. coli' WHEN 1 THEN 'S. aureus' WHEN 2 THEN 'MRSA N315' WHEN 3 THEN 'SA' ELSE n_name END AS label, CASE k WHEN 0 THEN 'escherichia coli' ELSE n_name END AS compared FROM (SELECT n_nationkey, n_name, CASE WHEN n_nationkey < 4 THEN n_nationkey ELSE 9 END AS k FROM nation)"
)
def normalize_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organism labels by type and alias; what isn't known stays."""
    k = F.col("n_nationkey")
    raw = F.when(k == 0, "Escherichia coli").when(k == 1, " Staph. aureus ").when(k == 2, "mrsa").when(k == 3, "S. aureus").otherwise(F.col("n_name"))
    kind = F.when(k == 3, "pMIC").otherwise("MIC")
    compared = F.when(k == 0, "E. coli").otherwise(F.col("n_name"))
    return _read(spark, sf_dir, "nation").select("n_nationkey", normalize.label(kind, raw).alias("label"), evaluate.canonical("bacteria", compared).alias("compared"))


def _doc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record a document: its first number as value, its first long word as compound, the text as evidence."""
    d = _read(spark, sf_dir, "documents")
    first = lambda p: F.coalesce(F.when(F.regexp_extract("text", p, 0) != "", F.regexp_extract("text", p, 0)), F.lit(MISSING))
    return d.select(
        "doc_id", F.col("source").alias("source_file"), first("[a-z]{9,}").alias("compound_id"), F.lit(MISSING).alias("smiles"), F.lit("MIC").alias("target_type"), F.lit("=").alias("target_relation"),
        first("[0-9]+").alias("target_value"), F.lit("µM").alias("target_units"), "lang", F.coalesce("lang", F.lit(MISSING)).alias("bacteria"), F.col("text").alias("evidence_text"),
    )


_CHECKED = r"""
r AS (SELECT doc_id, source, lang, text, CASE WHEN regexp_matches(text, '[a-z]{9,}') THEN regexp_extract(text, '[a-z]{9,}') ELSE 'NOT_DETECTED' END AS c, CASE WHEN regexp_matches(text, '[0-9]+') THEN regexp_extract(text, '[0-9]+') ELSE 'NOT_DETECTED' END AS v FROM documents),
m AS (SELECT *, list_filter([CASE WHEN c = 'NOT_DETECTED' THEN 'compound_id' END, CASE WHEN v = 'NOT_DETECTED' THEN 'target_value' END, CASE WHEN lang IS NULL THEN 'bacteria' END], lambda x: x IS NOT NULL) AS missing FROM r),
k AS (SELECT *, CASE WHEN len(missing) > 0 THEN 'missing required evidence-backed values: ' || array_to_string(missing, ', ') WHEN trim(text) = '' THEN 'empty evidence text'
  WHEN NOT regexp_matches(text, '(?:^|[^0-9.])' || v || '(?:$|[^0-9.])') THEN 'target_value is not supported by evidence text: ' || v END AS error FROM m)"""


@_query(f"WITH {_CHECKED}, i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM k) SELECT doc_id, error IS NULL AS accepted, CASE WHEN error IS NOT NULL THEN md5('record ' || i || ': ' || error) END AS message FROM i")
def validate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected records, each rejected one with its message."""
    d = validate.judged(_doc_records(spark, sf_dir), ["doc_id"])
    return d.select("doc_id", F.col("error").isNull().alias("accepted"), F.md5("message").alias("message"))


_FAILED = (
    f"{_CHECKED}, q AS (SELECT *, doc_id % 5 = 3 AS bad, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS raw_index FROM k),"
    " j AS (SELECT source, raw_index, 'normalise' AS stage, 'target_value must be a number, a numeric range, or NOT_DETECTED' AS reason, ['invalid target value'] AS c FROM q WHERE bad"
    " UNION ALL SELECT source, raw_index, 'validate', error, CASE WHEN len(missing) > 0 THEN list_concat(['missing required field'], CASE WHEN list_contains(missing, 'bacteria') THEN ['bacteria normalization problem'] ELSE [] END, CASE WHEN list_contains(missing, 'compound_id') THEN ['compound_id parsing problem'] ELSE [] END)"
    " WHEN starts_with(error, 'target_value') THEN ['invalid target value'] ELSE ['unknown'] END FROM q WHERE NOT bad AND error IS NOT NULL"
    " UNION ALL SELECT source, NULL, 'unmapped', unnest(['lost', 'no place named']), ['unknown'] FROM (SELECT DISTINCT source FROM k))"
)


def _failed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw records of whole documents (one value in five is no number), the accepted ones, and the channel: what
    normalisation refused and what validation's messages, written as JSON and read back, say of the rest."""
    raw = _doc_records(spark, sf_dir).withColumn("target_value", F.when(F.col("doc_id") % 5 == 3, "n/a").otherwise(F.col("target_value")))
    good, refused = failures.normalized(raw, ["doc_id"], ["source_file"])
    checked = validate.checked(good)
    said = checked.where("error is not null").select("source_file", F.concat(F.lit("record "), "record_index", F.lit(": "), "error").alias("message"))
    lost = raw.select("source_file").distinct().select("source_file", F.explode(F.array(F.lit("record 99999999999: lost"), F.lit("no place named"))).alias("message"))
    path = scratch.folder(spark, "messages")
    said.unionByName(lost).write.json(path)
    stored = spark.read.schema("source_file string, message string").json(path)
    return raw, checked.where("error is null"), refused.unionByName(failures.rebuilt(good, stored, ["source_file"]))


@_query(f"WITH {_FAILED} SELECT source AS source_file, raw_index, stage, md5(reason) AS reason, array_to_string(c, ';') AS categories FROM j")
def rejects_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each stage rejected, by the raw row's place, from stored messages."""
    channel = _failed(spark, sf_dir)[2]
    return channel.select("source_file", "raw_index", "stage", F.md5("reason").alias("reason"), F.array_join("categories", ";").alias("categories"))


@_query(
    f"WITH {_FAILED}, rej AS (SELECT source, count(*) FILTER (WHERE raw_index IS NOT NULL) AS rejected, count(*) FILTER (WHERE raw_index IS NULL) AS unmapped FROM j GROUP BY source), a AS (SELECT source, count(*) AS raw_rows, count(*) FILTER (WHERE NOT bad AND error IS NULL) AS accepted FROM q GROUP BY source)"
    " SELECT a.source AS source_file, raw_rows, accepted, rejected, unmapped, TRUE AS adds_up FROM a JOIN rej ON a.source IS NOT DISTINCT FROM rej.source"
)
def failure_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected rows of each source against its raw ones."""
    raw, accepted, channel = _failed(spark, sf_dir)
    return failures.balance(raw, accepted, channel, ["source_file"])


@_query(
    f"""WITH {_CHECKED}, x AS (SELECT doc_id, unnest(CASE WHEN len(missing) > 0 THEN list_concat(['missing required field'], CASE WHEN list_contains(missing, 'bacteria') THEN ['bacteria normalization problem'] ELSE [] END, CASE WHEN list_contains(missing, 'compound_id') THEN ['compound_id parsing problem'] ELSE [] END)
  WHEN starts_with(error, 'target_value') THEN ['invalid target value'] ELSE ['unknown'] END) AS category FROM k WHERE error IS NOT NULL)
SELECT category, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first FROM x GROUP BY category ORDER BY n DESC, first LIMIT 10"""
)
def reject_reasons_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten commonest categories of rejection."""
    d = validate.checked(_doc_records(spark, sf_dir)).where("error is not null")
    f = diagnose.rejection_fields(F.col("error"))
    d = d.select("doc_id", F.explode(diagnose.rejection_categories(F.col("error"), f, F.col("missing"))).alias("category"))
    return diagnose.most_common(d, "category", "doc_id")


_AS_RECORD = "SELECT doc_id, source, lang, md5(coalesce(text, '')) AS compound_id, 'MIC' AS target_type, '=' AS target_relation, CAST(n_chars AS VARCHAR) AS target_value, coalesce(lang, 'NOT_DETECTED') AS bacteria FROM documents"


def _text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record a document, named by its text: copies are equal records, sources their evidence."""
    d = _read(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("compound_id"), F.lit(MISSING).alias("smiles"), F.lit("MIC").alias("target_type"), F.lit("=").alias("target_relation"), F.col("n_chars").cast("string").alias("target_value"),
        F.lit("µM").alias("target_units"), F.coalesce("lang", F.lit(MISSING)).alias("bacteria"), F.col("source").alias("evidence_id"), F.array(F.concat(F.lit("from "), "lang")).alias("warnings"), F.lit("t").alias("source_text"),
    )


@_query(f"WITH r AS ({_AS_RECORD}) SELECT compound_id, target_value, bacteria, source AS evidence_id, min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS duplicate_count, 'from ' || any_value(lang) AS warnings FROM r GROUP BY compound_id, target_value, bacteria, source")
def dedup_evidence_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal records of one evidence merged into the first."""
    d = dedup.merged(_text_records(spark, sf_dir), ["doc_id"])
    return d.select("compound_id", "target_value", "bacteria", "evidence_id", "doc_id", "duplicate_count", F.array_join("warnings", ";").alias("warnings"))


def _lineitem_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "lineitem")
    return d.select(
        F.col("l_suppkey").alias("supplier"), F.col("l_partkey").cast("string").alias("compound_id"), F.lit(MISSING).alias("smiles"), F.col("l_returnflag").alias("target_type"), F.lit("=").alias("target_relation"),
        F.format_string("%.2f", "l_discount").alias("target_value"), F.col("l_linestatus").alias("target_units"), F.col("l_suppkey").cast("string").alias("bacteria"),
    )


@_query(
    "WITH g AS (SELECT l_partkey, l_suppkey, l_returnflag, list_sort(list_distinct(list(CAST(l_partkey AS VARCHAR) || '|NOT_DETECTED|' || l_returnflag || '|=|' || printf('%.2f', l_discount) || '|' || l_linestatus || '|' || CAST(l_suppkey AS VARCHAR)))) AS rows FROM lineitem GROUP BY ALL)"
    " SELECT CAST(l_partkey AS VARCHAR) AS compound_id, l_returnflag AS target_type, CAST(l_suppkey AS VARCHAR) AS bacteria, md5(array_to_string(rows, ';')) AS rows FROM g WHERE len(rows) > 1"
)
def conflict_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose records differ, and these records."""
    return dedup.conflicts(_lineitem_records(spark, sf_dir)).select("compound_id", "target_type", "bacteria", F.md5(F.array_join("rows", ";")).alias("rows"))


@_query(
    "WITH r AS (SELECT CAST(l_partkey AS VARCHAR) AS compound_id, l_returnflag AS target_type, CAST(l_suppkey AS VARCHAR) AS bacteria, l_partkey || '|NOT_DETECTED|' || l_returnflag || '|=|' || printf('%.2f', l_discount) || '|' || l_linestatus || '|' || l_suppkey AS row_text, count(*) AS n_same FROM lineitem GROUP BY ALL),"
    " n AS (SELECT *, count(*) OVER (PARTITION BY compound_id, target_type, bacteria) AS n_rows FROM r) SELECT compound_id, target_type, bacteria, row_text, n_same, n_rows FROM n WHERE n_rows > 1"
)
def conflict_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct record of the keys whose records differ, with its copies and its key's number of them."""
    return dedup.conflict_members(_lineitem_records(spark, sf_dir)).withColumnRenamed("row", "row_text")


@_query("WITH g AS (SELECT l_suppkey, l_partkey, l_returnflag, count(DISTINCT printf('%.2f', l_discount) || l_linestatus) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey AS supplier, CAST(count(*) AS BIGINT) AS conflict_count FROM g WHERE n > 1 GROUP BY l_suppkey")
def conflict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of disagreeing keys of each supplier."""
    return dedup.conflict_count(_lineitem_records(spark, sf_dir), ["supplier"])


@_query(
    """
WITH c AS (SELECT conv_id, turn, role, CAST(length(coalesce(text, '')) AS VARCHAR) AS t, row_number() OVER (ORDER BY conv_id, turn) - 1 AS i FROM conversations),
f AS (SELECT *, min(i) OVER (PARTITION BY role, t) AS f FROM c),
d AS (SELECT 'duplicate' AS kind, CAST(f AS VARCHAR) || ',' || CAST(i AS VARCHAR) AS indexes, t || '|MIC|=|NOT_DETECTED|' || 'u' || '|' || role AS key FROM f WHERE i > f)
SELECT kind, indexes, md5(key) AS key FROM d
"""
)
def candidate_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a role and length that came before, with the index of the first like it."""
    c = _read(spark, sf_dir, "conversations").select(F.length(F.coalesce("text", F.lit(""))).cast("string").alias("compound_id"), F.lit("MIC").alias("target_type"), F.lit("=").alias("target_relation"), F.lit(MISSING).alias("target_value"), F.lit("u").alias("target_units"), F.col("role").alias("bacteria"), "conv_id", "turn")
    per = c.groupBy("conv_id").agg(F.count("*").alias("n"))
    # numbers run on over blocks of a thousand ids, whose sums alone meet in one task, and within each
    per = per.withColumn("block", F.floor(F.col("conv_id") / 1000))
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = per.groupBy("block").agg(F.sum("n").alias("n")).select("block", before("block").alias("first"))
    per = per.withColumn("inside", before("block", "conv_id")).join(blocks, "block").select("conv_id", (F.col("first") + F.col("inside")).alias("start"))
    c = c.join(per, "conv_id").withColumn("candidate_index", F.col("start") + F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    d = dedup.candidate_conflicts(c).where("kind = 'duplicate'")
    return d.select("kind", F.array_join("indexes", ",").alias("indexes"), F.md5("key").alias("key"))


@_query(
    f"""WITH r AS ({_AS_RECORD}), s AS (SELECT *, count(*) OVER (PARTITION BY compound_id, target_value, bacteria, source) AS n_same, count(*) OVER (PARTITION BY compound_id, target_value, bacteria) AS n_key FROM r),
e AS (SELECT compound_id, target_value, bacteria, count(DISTINCT source) AS n_ev FROM r GROUP BY ALL)
SELECT doc_id, CAST(n_key AS VARCHAR) AS duplicate_count, CASE WHEN n_same > 1 THEN 'duplicate_same_evidence' WHEN n_key > 1 AND n_ev > 1 THEN 'repeated_distinct_evidence' WHEN n_key > 1 THEN 'duplicate_chemx_row' ELSE 'unique' END AS duplicate_status
FROM s JOIN e USING (compound_id, target_value, bacteria)"""
)
def duplicate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each document's text is repeated, within its source and beyond."""
    return dedup.duplicate_status(_text_records(spark, sf_dir)).select("doc_id", "duplicate_count", "duplicate_status")


@_query(
    f"""WITH r AS ({_AS_RECORD}), f AS (SELECT compound_id, target_value, bacteria, source, count(*) AS n FROM r GROUP BY ALL), w AS (SELECT compound_id, target_value, bacteria, sum(n) AS n, count(DISTINCT source) AS e, sum(n - 1) AS s FROM f GROUP BY ALL)
SELECT CAST(sum(n - 1) AS BIGINT) AS exact_duplicate_rows, CAST(sum(s) AS BIGINT) AS duplicates_with_same_evidence, CAST(coalesce(sum(CASE WHEN e > 1 THEN n END), 0) AS BIGINT) AS repeated_with_other_evidence FROM w"""
)
def duplicate_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_diagnostics(_text_records(spark, sf_dir))


@_query("SELECT doc_id, 'ev:' || substr(sha1(coalesce(trim(source), '') || '|' || doc_id || '|' || coalesce(lang, '') || '|' || coalesce(n_chars, 0)), 1, 12) AS evidence_id FROM documents")
def stable_evidence_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", dedup.evidence_id(F.col("source"), F.col("doc_id"), F.col("lang"), F.coalesce("n_chars", F.lit(0))).alias("evidence_id"))


def _status_bags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict]:
    """Line statuses by ship year as predictions, order statuses by order year as gold."""
    p = _read(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"), F.col("l_linestatus").alias("status"), F.month("l_shipdate").cast("string").alias("month"))
    t = _read(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status"), F.month("o_orderdate").cast("string").alias("month"))
    return p, t, {"status": F.col("status"), "month": F.col("month")}


_BAGS = """
p AS (SELECT {g}f AS field, CASE f WHEN 'status' THEN l_linestatus ELSE CAST(month(l_shipdate) AS VARCHAR) END AS value, count(*) AS n FROM lineitem, (VALUES ('status'), ('month')) v(f) {w1} GROUP BY ALL),
t AS (SELECT {g2}f AS field, CASE f WHEN 'status' THEN o_orderstatus ELSE CAST(month(o_orderdate) AS VARCHAR) END AS value, count(*) AS n FROM orders, (VALUES ('status'), ('month')) v(f) GROUP BY ALL),
b AS (SELECT {k}field, CAST(sum(least(coalesce(p.n, 0), coalesce(t.n, 0))) AS BIGINT) AS tp, CAST(sum(coalesce(p.n, 0)) AS BIGINT) AS np, CAST(sum(coalesce(t.n, 0)) AS BIGINT) AS nt FROM p FULL JOIN t USING ({k}field, value) GROUP BY ALL),
m AS (SELECT *, CASE WHEN np > 0 THEN tp / np ELSE 0 END AS pr, CASE WHEN nt > 0 THEN tp / nt ELSE 0 END AS rc FROM b),
f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1 FROM m)"""
_ALL = _BAGS.format(g="", g2="", w1="", k="")
_BY = _BAGS.format(g="year(l_shipdate) AS year, ", g2="year(o_orderdate) AS year, ", w1="", k="year, ")


@_query(f"WITH {_ALL} SELECT field, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1, tp AS true_positive FROM f")
def field_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset precision, recall and F1 of each field."""
    p, t, fields = _status_bags(spark, sf_dir)
    return evaluate.field_metrics(p, t, fields).select("field", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "true_positive")


@_query(f"WITH {_BY} SELECT CAST(year AS INTEGER) AS year, field, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1, tp AS true_positive FROM f")
def article_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by year."""
    p, t, fields = _status_bags(spark, sf_dir)
    return evaluate.field_metrics(p, t, fields, ["year"]).select("year", "field", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "true_positive")


@_query(
    f"SELECT 'group' AS level, CAST(year AS INTEGER) AS year, field, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1, tp AS true_positive FROM (WITH {_BY} SELECT * FROM f)"
    f" UNION ALL SELECT 'all', NULL, field, round(pr, 6), round(rc, 6), round(f1, 6), tp FROM (WITH {_ALL} SELECT * FROM f)"
)
def metrics_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both in one pass."""
    p, t, fields = _status_bags(spark, sf_dir)
    return evaluate.metrics_by_level(p, t, fields, ["year"]).select("level", "year", "field", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "true_positive")


@_query(f"WITH {_BY}, a AS (SELECT year, avg(pr) AS mp, avg(rc) AS mr, avg(f1) AS mf FROM f GROUP BY year) SELECT CAST(year AS INTEGER) AS year, round(mf, 6) AS macro_f1, round(CASE WHEN mp + mr > 0 THEN 2 * mp * mr / (mp + mr) ELSE 0 END, 6) AS f1_of_means FROM a")
def macro_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean F1, and F1 of mean precision and recall, by year."""
    p, t, fields = _status_bags(spark, sf_dir)
    return evaluate.summary(evaluate.field_metrics(p, t, fields, ["year"]), ["year"]).select("year", F.round("macro_f1", 6).alias("macro_f1"), F.round("f1_of_means", 6).alias("f1_of_means"))


@_query(f"WITH {_BY}, r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY f1, field) AS rn FROM f WHERE f1 < 1) SELECT CAST(year AS INTEGER) AS year, string_agg(field, ';' ORDER BY rn) AS worst_fields FROM r WHERE rn <= 3 GROUP BY year")
def worst_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst fields of each year."""
    p, t, fields = _status_bags(spark, sf_dir)
    return evaluate.worst_fields(evaluate.field_metrics(p, t, fields, ["year"]), ["year"])


@_query(
    r"SELECT page_id, regexp_replace(lower(regexp_replace(trim(n), '(?i)\.pdf$', '')), '^[0-9]+_', '') AS doc_key, regexp_replace(regexp_replace(n, '^.*[/\\]', ''), '(?i)\.[a-z0-9]+$', '') AS stem FROM (SELECT page_id, '12_' || coalesce(url, '') || '.PDF' AS n FROM pages)"
)
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names as keys."""
    n = F.concat(F.lit("12_"), F.coalesce("url", F.lit("")), F.lit(".PDF"))
    return _read(spark, sf_dir, "pages").select("page_id", evaluate.document_key(n, prefix=True).alias("doc_key"), T.file_stem(n).alias("stem"))


@_query("WITH b AS (SELECT DISTINCT source, lang FROM documents), c AS (SELECT DISTINCT source, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 0) SELECT CAST((SELECT count(*) FROM b) AS BIGINT) AS base, CAST(count(*) AS BIGINT) AS kept, count(*) / (SELECT count(*) FROM b) AS recall FROM b SEMI JOIN c ON b.source = c.source AND b.lang = c.lang")
def recall_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of (source, language) keys that also occur among bad documents."""
    d = _read(spark, sf_dir, "documents")
    bad = d.join(_read(spark, sf_dir, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_semi")
    return evaluate.set_recall(d, bad, ["source", "lang"])


@_query(
    f"""
WITH {_LINES}, {_CHECKED},
d AS (SELECT DISTINCT source FROM documents),
c AS (SELECT source, count(*) AS chunks, count(CASE WHEN contains(line, ' | ') THEN 1 END) AS tchunks, count(DISTINCT doc_id) AS pages FROM l WHERE regexp_matches(line, '[0-9]{{2,}}') GROUP BY source),
v AS (SELECT source, count(*) AS raw, count(CASE WHEN len(missing) > 0 THEN 1 END) AS gaps, count(CASE WHEN error IS NULL THEN 1 END) AS ok, count(CASE WHEN error IS NOT NULL THEN 1 END) AS bad, count(DISTINCT CASE WHEN error IS NULL THEN doc_id END) AS rpages, avg(CASE WHEN error IS NULL THEN CASE WHEN doc_id % 2 = 0 THEN 0.9 ELSE 0.6 END END) AS conf FROM k GROUP BY source),
q AS (SELECT source, c, lang, count(DISTINCT v) AS n FROM k WHERE error IS NULL GROUP BY ALL),
x AS (SELECT source, count(*) AS conflicts FROM q WHERE n > 1 GROUP BY source),
s AS (SELECT d.source, coalesce(chunks, 0) AS chunks, coalesce(tchunks, 0) AS tchunks, coalesce(pages, 0) AS pages, raw, gaps, ok, bad, rpages, coalesce(conflicts, 0) AS conflicts, coalesce(conf, 0) AS conf, CASE WHEN length(d.source) = 4 THEN 1 ELSE 0 END AS tables FROM d LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source LEFT JOIN v ON d.source IS NOT DISTINCT FROM v.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source),
i AS (SELECT *, list_filter([CASE WHEN chunks = 0 THEN 'no_evidence' END, CASE WHEN tables = 0 THEN 'no_parsed_tables' WHEN tchunks = 0 THEN 'no_table_evidence' END, CASE WHEN tchunks > 0 THEN 'no_table_records' END, CASE WHEN pages > 0 AND rpages / pages < 0.35 AND conf < 0.75 THEN 'low_evidence_page_coverage' END, CASE WHEN conf < 0.7 AND ok > 0 THEN 'low_average_record_confidence' END,
  CASE WHEN bad / (ok + bad) > 0.25 THEN 'high_validation_rejection_ratio' END, CASE WHEN gaps / raw > 0.25 THEN 'many_missing_required_fields' END, CASE WHEN conflicts > 0 THEN 'conflicting_rule_records' END, CASE WHEN ok = 0 AND chunks > 0 THEN 'no_validated_records' END], lambda y: y IS NOT NULL) AS issues FROM s)
SELECT source, array_to_string(issues, ';') AS issues, CASE WHEN len(issues) >= 2 OR list_has_any(issues, ['no_evidence', 'high_validation_rejection_ratio', 'many_missing_required_fields', 'no_validated_records']) THEN 'low' WHEN len(issues) > 0 THEN 'medium' ELSE 'high' END AS confidence,
  round(bad / (ok + bad), 3) AS rejection, round(CASE WHEN pages > 0 THEN rpages / pages ELSE 0 END, 3) AS coverage, CAST(14 AS INTEGER) AS n_signals, round(tables + chunks + tchunks + raw + ok + bad + bad / (ok + bad) + conf + pages + rpages + CASE WHEN pages > 0 THEN rpages / pages ELSE 0 END + gaps / raw + conflicts, 1) AS signal_sum FROM i
"""
)
def confidence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues and rating of each source: lines with numbers are its evidence, documents its pages."""
    docs = _read(spark, sf_dir, "documents").select("source").distinct().select(F.col("source").alias("source_file"), F.when(F.length("source") == 4, 1).otherwise(0).alias("tables"))
    chunks = _lines(spark, sf_dir).where(F.col("line").rlike(DOCS.interesting)).select(F.col("source").alias("source_file"), F.col("doc_id").alias("page"), F.when(F.col("line").contains(" | "), "t").alias("table_id"))
    raw = _doc_records(spark, sf_dir)
    checked = validate.checked(raw).select("*", F.col("doc_id").alias("page"), F.lit(None).cast("string").alias("table_id"), F.lit("docs.rules.prose").alias("extraction_method"), F.when(F.col("doc_id") % 2 == 0, 0.9).otherwise(0.6).alias("confidence"))
    d = diagnose.confidence_report(docs, chunks, raw, checked)
    return d.select(F.col("source_file").alias("source"), F.array_join(F.transform("issues", lambda i: i["code"]), ";").alias("issues"), "confidence", F.round("validation_rejection_ratio", 3).alias("rejection"), F.round("evidence_page_coverage_ratio", 3).alias("coverage"), F.size("signals").alias("n_signals"), F.round(F.aggregate(F.map_values("signals"), F.lit(0.0), lambda a, x: a + x), 1).alias("signal_sum"))


_STAGES = (
    "WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT c_custkey, c_nationkey, c_acctbal, coalesce(n, 0) AS rows FROM customer LEFT JOIN o ON c_custkey = o_custkey),"
    " b AS (SELECT *, CASE WHEN rows = 0 AND c_nationkey = 0 THEN 'expected-zero' WHEN rows = 0 THEN 'zero-row' WHEN rows < 5 THEN 'low-row' ELSE 'ok' END AS row_bucket,"
    f" CASE WHEN rows = 0 AND c_nationkey = 0 THEN '{diagnose.EXPECTED_ZERO}' WHEN rows > 0 THEN '{diagnose.UNKNOWN}' WHEN NOT c_acctbal > 0 THEN '{diagnose.NO_PARSE}' WHEN c_nationkey = 1 THEN '{diagnose.NO_CONTENT}' WHEN c_nationkey < 5 THEN '{diagnose.NO_EVIDENCE}' WHEN c_nationkey < 9 THEN '{diagnose.NO_CANDIDATES}' ELSE '{diagnose.NO_EXPORT}' END AS failure_stage FROM c)"
)


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents: their orders are rows, the nation stands for what was found."""
    n = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    d = _read(spark, sf_dir, "customer").join(n, "c_custkey", "left").withColumn("rows", F.coalesce("n", F.lit(0)))
    k = F.col("c_nationkey")
    stage = diagnose.failure_stage(F.col("c_acctbal") > 0, k - 1, F.lit(0), F.greatest(k - 4, F.lit(0)), F.greatest(k - 8, F.lit(0)), F.col("rows"), k)
    return d.withColumns({"row_bucket": diagnose.row_bucket(F.col("rows"), 5, k), "failure_stage": stage})


@_query(_STAGES + " SELECT c_custkey, row_bucket, failure_stage FROM b")
def failure_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _staged(spark, sf_dir).select("c_custkey", "row_bucket", "failure_stage")


@_query(_STAGES + " SELECT row_bucket, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY row_bucket")
def bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.histogram(_staged(spark, sf_dir), "row_bucket")


@_query("SELECT doc_id, CASE WHEN l IS NULL THEN 'missing' WHEN d IS NULL THEN 'extra' ELSE 'existing' END AS status FROM (SELECT DISTINCT doc_id, 1 AS d FROM documents) FULL JOIN (SELECT DISTINCT doc_id, 1 AS l FROM labels) USING (doc_id)")
def inventory_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents have no label, and which labels no document."""
    return diagnose.inventory(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), "doc_id")


@_query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(json_extract_string(props, '$.k')) AS BIGINT) AS n_valid, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY event_type")
def json_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties read tolerantly."""
    k = tolerant_json(F.col("props"), "k long")["k"]
    return _read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("n_valid"), F.sum(k).alias("k_sum"))


@_query("SELECT conv_id, turn, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) // 3 AS INTEGER) AS batch FROM conversations")
def batching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in batches of three."""
    return replay.batches(_read(spark, sf_dir, "conversations"), 3, ["conv_id"], ["turn", "role", "text"]).select("conv_id", "turn", "batch")


@_query("WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn FROM n WHERE i >= 1 AND i < greatest(n - 1, 0)")
def evidence_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns 1:-1 of each conversation."""
    return evidence.sliced(_read(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role", "text"], "1:-1").select("conv_id", "turn")


@_query("WITH s AS (SELECT conv_id, list_sort(list_distinct(list(CASE role WHEN 'user' THEN 'live' WHEN 'assistant' THEN 'replay' ELSE 'cached_live' END))) AS s FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN NOT list_contains(s, 'replay') THEN 'live' WHEN NOT list_contains(s, 'live') THEN 'replay' ELSE 'partial_live' END AS status FROM s")
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status of a conversation's batches."""
    s = F.when(F.col("role") == "user", "live").when(F.col("role") == "assistant", "replay").otherwise("cached_live")
    return _read(spark, sf_dir, "conversations").withColumn("status", s).groupBy("conv_id").agg(replay.combined_status("status").alias("status"))


@_query(
    r"""
WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+')) AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN t = 'NOT_DETECTED' THEN 'not_applicable' WHEN regexp_matches(t, '\*|(^|[^A-Za-z0-9])R\p{Nd}*([^\p{L}\p{M}\p{Nd}\p{Pc}]|$)|(^|[^A-Za-z0-9])Ar([^\p{L}\p{M}\p{Nd}\p{Pc}]|$)') THEN 'generic_scaffold'
  WHEN regexp_matches(t, '[\x{85}\p{Z}]') OR (length(t) - length(replace(t, '(', ''))) <> (length(t) - length(replace(t, ')', ''))) OR (length(t) - length(replace(t, '[', ''))) <> (length(t) - length(replace(t, ']', ''))) THEN 'invalid' ELSE 'not_configured' END AS status FROM w)
SELECT doc_id, status, CAST(count(*) AS BIGINT) AS n_words FROM s GROUP BY doc_id, status
"""
)
def structure_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structure check of every word of the whole texts, counted by document and status."""
    w = _read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+")).alias("w"))
    return w.groupBy("doc_id", validate.structure_status(F.col("w")).alias("status")).agg(F.count("*").alias("n_words"))
