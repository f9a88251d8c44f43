"""Sinks: fixed-column tables, sidecars, metrics, audits. All but Markdown are Spark writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, columns: tuple[str, ...], form: str = "csv", one_file: bool = False) -> None:
    """Exactly these columns in this order; further ones are an error. one_file: for a small published table."""
    extra = sorted(set(df.columns) - set(columns))
    if extra or (lost := [c for c in columns if c not in df.columns]):
        raise ValueError(f"columns must be {list(columns)}: extra {extra}, missing {lost if not extra else []}")
    d = df.select(*[F.col(f"`{c}`") for c in columns])
    d = d.coalesce(1) if one_file else d
    (d.write.mode("overwrite").option("header", True).option("escape", '"').csv(path) if form == "csv" else d.write.mode("overwrite").json(path))


def write_records(records: DataFrame, path: str, columns: tuple[str, ...], review: DataFrame | None = None) -> None:
    """Predictions as CSV, with their evidence as JSON, and review rows beside them."""
    write_table(records.select(*[F.col(f"`{c}`") for c in columns]), f"{path}/predictions.csv", columns)
    records.write.mode("overwrite").json(f"{path}/predictions_with_evidence.json")
    if review is not None:
        review.write.mode("overwrite").json(f"{path}/review_records.json")
        review.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/review_records.csv")


def write_merged(merged: DataFrame, evidence: DataFrame, path: str, columns: tuple[str, ...]) -> None:
    """Deduplicated rows as CSV, a sidecar with each row's evidence, and the deduplication report."""
    write_table(merged.select(*[F.col(f"`{c}`") for c in columns]), f"{path}/predictions.csv", columns)
    e = evidence.groupBy("evidence_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in evidence.columns if c != "evidence_id"]))).alias("merged_evidence"))
    merged.join(e, "evidence_id", "left").write.mode("overwrite").json(f"{path}/predictions_with_evidence.json")
    report = merged.agg(F.sum("duplicate_count").alias("input_records"), F.count("*").alias("output_records"), F.sum(F.col("duplicate_count") - 1).alias("exact_duplicates_merged"))
    report.write.mode("overwrite").json(f"{path}/dedup_report.json")


def write_metrics(metrics: DataFrame, summary: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/metrics.json")
    metrics.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/field_metrics.csv")


def write_summary(articles: DataFrame, manifest: dict, path: str) -> None:
    articles.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/article_summary.csv")
    spark = articles.sparkSession
    spark.createDataFrame([(str(k), str(v)) for k, v in sorted(manifest.items())], "key string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/run_manifest.json")


def write_parsed(parsed: DataFrame, path: str) -> None:
    parsed.write.mode("overwrite").json(path)


def write_packed(files: DataFrame, path: str) -> None:
    """Small text files (path, value) as rows of a table, which artifacts.read_artifacts reads as `packed`: what is written and listed
    grows with their bytes, not with their number. A reading task holds a batch of 4,096 of them, so they should be small."""
    files.select("path", "value").write.mode("overwrite").parquet(path)


def write_sidecars(parts: dict[str, DataFrame], path: str) -> None:
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{path}/{name}.json")


def markdown(title: str, df: DataFrame, most: int = 50) -> str:
    """The first `most` rows as a Markdown table, for a report people read."""
    rows = df.limit(most).collect()
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    out = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(out + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"


def write_audit(audit: DataFrame, title: str, path: str, most: int = 50) -> str:
    """An audit as CSV and JSON; returns its Markdown."""
    audit.write.mode("overwrite").json(f"{path}/audit.json")
    flat = audit.select(*[F.concat_ws(";", c).alias(c) if t.startswith("array<string") else F.col(c) for c, t in audit.dtypes if not t.startswith(("struct", "map", "array<struct"))])
    flat.write.mode("overwrite").option("header", True).csv(f"{path}/audit.csv")
    return markdown(title, flat, most)


def write_harness(articles: DataFrame, report: DataFrame, path: str) -> None:
    """The harness's report over all documents as JSON, and its row of each document as JSON and CSV."""
    report.coalesce(1).write.mode("overwrite").json(f"{path}/harness_report.json")
    articles.write.mode("overwrite").json(f"{path}/article_reports.json")
    articles.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/harness_summary.csv")


def write_missing(inventory: DataFrame, path: str) -> None:
    """The names of an inventory that are listed but not there, as CSV."""
    key = next(c for c in inventory.columns if c != "status")
    inventory.where("status = 'missing'").select(key).orderBy(key).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_evidence(evidence: DataFrame, path: str) -> None:
    """Selected evidence, a JSON row each, in the order of its places."""
    order = [c for c in ("source_file", "part", "ord1", "ord2") if c in evidence.columns]
    evidence.orderBy(*order).write.mode("overwrite").json(path)
