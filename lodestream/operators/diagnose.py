"""Confidence reports per document, and audits of what a run left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.dedup import conflict_count
from lodestream.spec import MISSING, REQUIRED, TABLE_LIKE

# The audit's outcomes and what to do next.
NO_PARSE = "no parsed artifact"
NO_CONTENT = "parse exists but no tables/text"
NO_EVIDENCE = "tables/text exist but no evidence"
NO_CANDIDATES = "evidence exists but no raw candidates"
NO_EXPORT = "candidates exist but validation/export produced zero rows"
EXPECTED_ZERO = "expected zero-row / no GT records"
UNKNOWN = "unknown"
NEXT_ACTION = {
    NO_PARSE: "Inspect parser stdout/stderr and rerun only the parser for this PDF.",
    NO_CONTENT: "Open the raw parser JSON and PDF pages to check scanned/column layout issues.",
    NO_EVIDENCE: "Inspect parsed tables/text for MIC, pMIC, bacteria, and compound labels missed by evidence selection.",
    NO_CANDIDATES: "Inspect rule_evidence.json against rule extractor patterns for unsupported table/text layouts.",
    NO_EXPORT: "Inspect confidence_report.json validation signals and rule evidence to see why candidates were rejected.",
    EXPECTED_ZERO: "No extraction debug needed; the run has zero ground-truth rows for this PDF.",
}
NEXT_OTHERWISE = "Review artifact counts and per-article stdout/stderr to choose the next focused debug path."


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def signals(documents: DataFrame, chunks: DataFrame, raw: DataFrame, checked: DataFrame, by: str = "source_file") -> DataFrame:
    """Counts and ratios of each document: documents (by, tables), chunks (page, table_id), raw records
    (five required columns), checked records (error, page, table_id, extraction_method, confidence)."""
    c = chunks.groupBy(by).agg(F.count("*").alias("evidence_chunks"), F.count("table_id").alias("table_evidence_chunks"), F.count_distinct("page").alias("evidence_page_count"))
    gap = F.array_contains(F.array(*REQUIRED), MISSING)
    r = raw.groupBy(by).agg(F.count("*").alias("raw_records"), F.count_if(gap).alias("raw_missing"))
    ok = F.col("error").isNull()
    v = checked.groupBy(by).agg(
        F.count_if(ok).alias("validated_records"), F.count_if(~ok).alias("validation_errors"), F.count_if(ok & F.col("table_id").isNotNull()).alias("table_records"),
        F.count_if(ok & (F.col("table_id").eqNullSafe(TABLE_LIKE) | F.col("extraction_method").contains("table"))).alias("table_like_records"),
        F.avg(F.when(ok, F.col("confidence"))).alias("average_record_confidence"), F.count_distinct(F.when(ok, F.col("page"))).alias("record_page_count"),
    )
    k = conflict_count(checked.where(ok), [by])
    d = documents.select(by, F.col("tables").alias("parsed_tables"))
    for x in (c, r, v, k):
        d = d.join(x, by, "left")
    d = d.fillna(0)
    return d.withColumns({
        "validation_rejection_ratio": _ratio(F.col("validation_errors"), F.col("validated_records") + F.col("validation_errors")),
        "evidence_page_coverage_ratio": _ratio(F.col("record_page_count"), F.col("evidence_page_count")),
        "missing_required_field_ratio": _ratio(F.col("raw_missing"), F.col("raw_records")),
    })


def _issues() -> Column:
    c = F.col
    issue = lambda when, code, level: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(level).alias("severity")))
    no_tables = (c("parsed_tables") == 0) & (c("table_like_records") == 0)
    return F.array_compact(F.array(
        issue(c("evidence_chunks") == 0, "no_evidence", "high"),
        F.coalesce(issue(no_tables, "no_parsed_tables", "medium"), issue((c("parsed_tables") > 0) & (c("table_evidence_chunks") == 0), "no_table_evidence", "medium")),
        issue((c("table_records") == 0) & (c("table_evidence_chunks") > 0), "no_table_records", "medium"),
        issue((c("evidence_page_coverage_ratio") < 0.35) & (c("evidence_page_count") > 0) & (c("average_record_confidence") < 0.75), "low_evidence_page_coverage", "medium"),
        issue((c("average_record_confidence") < 0.7) & (c("validated_records") > 0), "low_average_record_confidence", "medium"),
        issue(c("validation_rejection_ratio") > 0.25, "high_validation_rejection_ratio", "high"),
        issue(c("missing_required_field_ratio") > 0.25, "many_missing_required_fields", "high"),
        issue(c("conflict_count") > 0, "conflicting_rule_records", "medium"),
        issue((c("validated_records") == 0) & (c("evidence_chunks") > 0), "no_validated_records", "high"),
    ))


_SIGNALS = (
    "parsed_tables", "evidence_chunks", "table_evidence_chunks", "table_like_records", "raw_records", "validated_records", "validation_errors", "validation_rejection_ratio", "average_record_confidence",
    "evidence_page_count", "record_page_count", "evidence_page_coverage_ratio", "missing_required_field_ratio", "conflict_count",
)


def confidence_report(documents: DataFrame, chunks: DataFrame, raw: DataFrame, checked: DataFrame, by: str = "source_file") -> DataFrame:
    """Issues, rating and signals (ratios to four places) of each document."""
    d = signals(documents, chunks, raw, checked, by).withColumn("issues", _issues())
    run = F.exists("issues", lambda i: i["severity"] == "high") | (F.size("issues") >= 2)
    d = d.withColumn("should_run_model", run).withColumn("confidence", F.when(F.col("should_run_model"), "low").when(F.size("issues") > 0, "medium").otherwise("high"))
    shown = F.create_map(*[x for s in _SIGNALS for x in (F.lit(s), F.bround(F.col(s).cast("double"), 4))])
    return d.withColumn("signals", shown)


def row_bucket(rows: Column, low: int = 5, gold: Column | None = None) -> Column:
    """How a document's number of rows looks; without `gold` nothing is expected to be zero."""
    out = F.when((rows == 0) & (gold == 0), "expected-zero") if gold is not None else F.when(F.lit(False), "")
    return out.when(rows == 0, "zero-row").when(rows < low, "low-row").otherwise("ok")


def failure_stage(parsed: Column, blocks: Column, tables: Column, chunks: Column, candidates: Column, rows: Column, gold: Column | None = None) -> Column:
    """The first stage after which a document had nothing more."""
    out = F.when((rows == 0) & (gold == 0), EXPECTED_ZERO) if gold is not None else F.when(F.lit(False), "")
    return out.when(rows > 0, UNKNOWN).when(~parsed, NO_PARSE).when((blocks == 0) & (tables == 0), NO_CONTENT).when(chunks == 0, NO_EVIDENCE).when(candidates == 0, NO_CANDIDATES).otherwise(NO_EXPORT)


def next_action(stage: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in NEXT_ACTION.items() for x in kv])
    return F.coalesce(F.try_element_at(m, stage), F.lit(NEXT_OTHERWISE))


def document_audit(documents: DataFrame, artifacts: DataFrame, report: DataFrame, by: str = "source_file", low: int = 5) -> DataFrame:
    """documents (rows, gold), left-joined with artifact counts and the report's signals, which come first."""
    pick = lambda s, a: F.coalesce(F.try_element_at("signals", F.lit(s)).cast("long"), F.col(a).cast("long"), F.lit(0))
    d = documents.join(artifacts, by, "left").join(report.select(by, "signals"), by, "left")
    d = d.withColumns({"parsed": F.coalesce("parsed", F.lit(False)), "text_blocks": F.coalesce("text_blocks", F.lit(0)), "tables_seen": pick("parsed_tables", "tables_found"), "chunks_seen": pick("evidence_chunks", "chunks_found"), "candidates_seen": pick("raw_records", "candidates_found")})
    stage = failure_stage(F.col("parsed"), F.col("text_blocks"), F.col("tables_seen"), F.col("chunks_seen"), F.col("candidates_seen"), F.col("rows"), F.col("gold"))
    d = d.withColumns({"row_bucket": row_bucket(F.col("rows"), low, F.col("gold")), "failure_stage": stage})
    return d.withColumn("next_action", next_action(F.col("failure_stage"))).select(by, "rows", "gold", "row_bucket", "failure_stage", "next_action", "parsed", "text_blocks", "tables_seen", "chunks_seen", "candidates_seen")


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def rejection_fields(error: Column) -> Column:
    """Fields that an error speaks of: the listed missing ones, else those it names."""
    listed = F.transform(F.split(F.regexp_extract(error, r"missing required evidence-backed values:\s*(.+)$", 1), ","), lambda x: F.trim(x))
    named = F.array_compact(F.array(*[F.when(error.contains(f), F.lit(f)) for f in ("compound_id", "target_type", "target_relation", "target_value", "target_units", "bacteria", "smiles")], F.when(error.contains("empty evidence text"), F.lit("evidence"))))
    return F.when(error.contains("missing required evidence-backed values:"), F.filter(listed, lambda x: x != "")).otherwise(F.array_distinct(named))


def rejection_categories(error: Column, fields: Column, missing: Column) -> Column:
    """Why a row was rejected, in fixed order; `unknown` if nothing fits. missing: the fields that are missing."""
    low = F.lower(error)
    has = lambda f: F.array_contains(fields, f)
    there = lambda f: ~F.array_contains(missing, f)
    rules = [
        (low.contains("missing required") | F.arrays_overlap(fields, missing), "missing required field"), ((has("target_value") | low.contains("target_value")) & there("target_value"), "invalid target value"),
        (has("target_units") & there("target_units"), "invalid target units"), (has("target_relation") & there("target_relation"), "invalid target relation"), (has("target_type") & there("target_type"), "invalid target type"),
        (has("bacteria"), "bacteria normalization problem"), (has("compound_id"), "compound_id parsing problem"), (has("smiles"), "SMILES handling problem"),
        (low.contains("duplicate") | low.contains("dedup"), "duplicate/dedup issue"), (low.contains("schema") | low.contains("export"), "export schema issue"),
    ]
    out = F.array_compact(F.array(*[F.when(F.coalesce(w, F.lit(False)), F.lit(n)) for w, n in rules]))
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.lit("unknown")))


def most_common(df: DataFrame, column: str, order: str, n: int = 10) -> DataFrame:
    """The n commonest values, ties to the one that came first. A report of n rows."""
    return df.groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first").limit(n)


def first_examples(df: DataFrame, by: list[str], order: list[str], n: int = 5) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= n).drop("rn")


def inventory(listed: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Every distinct key with its status: missing (only listed), existing, or extra (only present)."""
    a, b = listed.select(key).distinct().withColumn("a", F.lit(True)), present.select(key).distinct().withColumn("b", F.lit(True))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("existing")
    return a.join(b, key, "full").select(key, status.alias("status"))


def document_flags(rows: Column, gold: Column) -> Column:
    """Short marks of a document's outcome."""
    return F.array_compact(F.array(F.when(rows == 0, F.lit("no predictions")), F.when(gold == 0, F.lit("no gold rows")), F.when((rows > 0) & (gold > 0) & (rows > 3 * gold), F.lit("many predictions"))))


def key_field_weakness(worst: Column, keys: tuple[str, ...] = ("compound_id", "target_value", "bacteria")) -> Column:
    """Which key fields are among the worst."""
    return F.array_intersect(F.split(F.coalesce(worst, F.lit("")), ";"), F.array(*map(F.lit, keys)))


def article_summary(documents: DataFrame, summary: DataFrame, worst: DataFrame, report: DataFrame, by: str = "source_file") -> DataFrame:
    """One row a document: counts, scores, rating and worst fields; documents carry status and error."""
    d = documents.join(summary, by, "left").join(worst, by, "left").join(report.select(by, "confidence", "should_run_model"), by, "left")
    return d.withColumn("worst_fields", F.coalesce("worst_fields", F.lit("")))


def selected(audit: DataFrame | None, summary: DataFrame, include: DataFrame | None = None, by: str = "source_file", low: int = 5) -> DataFrame:
    """The documents to look at: rows of an earlier audit (by, rows, row_bucket) where it has the document, else of the
    summary (by, rows), bucketed here; those asked for in `include`, or else those with no or few rows."""
    rows = summary.select(by, "rows", row_bucket(F.col("rows"), low).alias("row_bucket"))
    if audit is not None:
        rows = audit.select(by, "rows", "row_bucket").unionByName(rows.join(audit.select(by), by, "left_anti"))
    if include is not None:
        return rows.join(include.select(by).distinct(), by, "left_semi")
    return rows.where(F.col("row_bucket").isin("zero-row", "low-row"))


def artifacts(documents: DataFrame, files: DataFrame, by: str = "source_file") -> DataFrame:
    """Each document's files (by, name, content), and how many blocks and tables its first parsed file
    (`raw/*.json`, by name) has; 0 where there is none or it cannot be read."""
    shape = "text_blocks array<string>, tables array<string>"
    parsed = F.when(F.col("name").rlike(r"^raw/.*\.json$"), F.struct("name", F.when(F.try_parse_json("content").isNotNull(), F.from_json("content", shape)).alias("p")))
    got = files.groupBy(by).agg(F.array_sort(F.collect_set("name")).alias("files"), F.min_by(parsed["p"], parsed["name"]).alias("p"))
    count = lambda c: F.greatest(F.coalesce(F.size(F.col(f"p.{c}")), F.lit(0)), F.lit(0))
    d = documents.join(got, by, "left")
    return d.select(*documents.columns, F.coalesce("files", F.array().cast("array<string>")).alias("files"), count("text_blocks").alias("text_blocks"), count("tables").alias("tables"))


def rejects(checked: DataFrame, preview: int = 300) -> DataFrame:
    """Rejected rows (of validate.checked) with the fields and categories of their reason and the beginning of their evidence."""
    d = checked.where("error is not null").withColumn("fields", rejection_fields(F.col("error")))
    d = d.withColumn("categories", rejection_categories(F.col("error"), F.col("fields"), F.col("missing")))
    return d.withColumn("preview", F.substring(F.coalesce("evidence_text", F.lit("")), 1, preview))


def harness_report(articles: DataFrame, by: str = "source_file") -> DataFrame:
    """One row of the harness summary: documents, how many ended well, answers and valid ones, mean score.
    articles: by, status, responses, valid_responses, macro_f1."""
    total = F.coalesce(F.sum("responses"), F.lit(0))
    return articles.agg(
        F.count(by).alias("articles"), F.count_if(F.col("status") == "ok").alias("ok"), total.alias("responses"), F.coalesce(F.sum("valid_responses"), F.lit(0)).alias("valid_responses"),
        F.when(total > 0, F.sum("valid_responses") / total).alias("valid_json_ratio"), F.avg("macro_f1").alias("macro_f1"),
    )
