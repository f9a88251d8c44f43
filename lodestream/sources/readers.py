"""Sources: PDF folders, parsed documents, CSV and JSON artifacts. Spark's readers open every path."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestream.functions import text as T
from lodestream.functions.json import strict
from lodestream.operators.evidence import PARSED
from lodestream.operators.validate import refuse_forbidden
from lodestream.sources import artifacts


def listing(spark: SparkSession, folder: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """path, name and length of a folder's files, by lower-cased name."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    return f.withColumn("name", F.regexp_replace("path", r"^.*/", "")).orderBy(F.lower("name"))


def included(files: DataFrame, names: list[str] | None) -> DataFrame:
    """The files named, whatever their case; all without names. Names of no file are an error."""
    if not names:
        return files
    spark = files.sparkSession
    want = spark.createDataFrame([(n.lower(),) for n in names], "k string").distinct()
    have = files.withColumn("k", F.lower("name"))
    lost = [r.k for r in want.join(have.select("k").distinct(), "k", "left_anti").orderBy("k").collect()]  # of the names given
    if lost:
        raise ValueError(f"not found: {lost}")
    return have.join(want, "k", "left_semi").drop("k")


def clean_cell(c: Column) -> Column:
    """Blanks collapsed in each line, blank lines dropped; null is empty."""
    return F.array_join(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), T.collapse), lambda x: x != ""), "\n")


def cleaned_tables(tables: Column) -> Column:
    """Tables with clean cells, without blank rows, and without tables left empty."""
    rows = lambda t: F.filter(F.transform(t["rows"], lambda r: F.transform(r, clean_cell)), lambda r: F.exists(r, lambda c: c != ""))
    out = F.transform(tables, lambda t: F.struct(t["table_id"].alias("table_id"), rows(t).alias("rows"), t["source"].alias("source")))
    return F.filter(out, lambda t: F.size(t["rows"]) > 0)


def block_confidence(text: Column) -> Column:
    return F.when(T.strip(F.coalesce(text, F.lit(""))) == "", 0.1).otherwise(0.9)


def _cell(c: str | None) -> str:
    """clean_cell for a value in Python."""
    return "\n".join(x for x in (" ".join(y.split()) for y in (c or "").split("\n")) if x)


def _parse_pdf(name: str, data: bytes) -> dict:
    import pdfplumber  # a worker without it reports so in each row's error

    src = lambda page, table, method, conf: {"source_file": name, "page": page, "section": None, "table_id": table, "figure_id": None, "row_index": None, "extraction_method": method, "confidence": conf}
    blocks, tables = [], []
    with pdfplumber.open(io.BytesIO(data)) as pdf:
        meta = {str(k): str(v) for k, v in (pdf.metadata or {}).items()}
        for p, page in enumerate(pdf.pages, 1):
            text = page.extract_text() or ""
            blocks.append({"text": text, "source": src(p, None, "pdf.text", 0.9 if text.strip() else 0.1)})
            for t, rows in enumerate(page.extract_tables() or [], 1):
                cells = [[_cell(c) for c in row] for row in rows]
                if cells := [r for r in cells if any(r)]:
                    tables.append({"table_id": f"p{p}_t{t}", "rows": cells, "source": src(p, f"p{p}_t{t}", "pdf.table", 0.75)})
        return {"source_file": name, "page_count": len(pdf.pages), "metadata": meta, "text_blocks": blocks, "tables": tables}


def read_pdfs(spark: SparkSession, folder: str, stream: bool = False, fail_fast: bool = False) -> DataFrame:
    """Parsed documents of a folder, one row a file, with status and error: a bad file fails alone, or with
    fail_fast ends the job."""
    refuse_forbidden(folder)
    files = _binary_stream(spark, folder) if stream else spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return parse_files(files, _parse_pdf, fail_fast)


def _binary_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)


def parse_files(files: DataFrame, parser, fail_fast: bool = False) -> DataFrame:
    """files: path, content. parser: (name, bytes) to a parsed document's fields."""

    def run(frames):
        for f in frames:
            rows = []
            for path, data in zip(f["path"], f["content"], strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    rows.append(parser(name, bytes(data)) | {"status": "ok", "error": ""})
                except Exception as x:  # one document's failure is a row, not the job's end
                    if fail_fast:
                        raise
                    rows.append({"source_file": name, "page_count": 0, "metadata": {}, "text_blocks": [], "tables": [], "status": "failed", "error": f"{type(x).__name__}: {x}"})
            yield pd.DataFrame(rows)

    return files.select("path", "content").mapInPandas(run, f"{PARSED}, status string, error string")


def read_parsed(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    """Parsed documents stored as JSON: an object or an array a file, or lines. A file or line that holds something else ends the
    job, or with `keep` is a row with path and error, or with `drop` is left out. Gold data and earlier outputs are refused."""
    refuse_forbidden(path)
    d = artifacts.typed(artifacts.read_artifacts(spark, path), PARSED, on_error)
    return d if on_error == "keep" else d.drop("path")


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every value a string, empty ones kept, a byte order mark taken off."""
    d = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').option("nullValue", "\x00").option("emptyValue", "").csv(path)
    return d.toDF(*[c.lstrip("﻿") for c in d.columns]).na.fill("")


def read_predictions(spark: SparkSession, pattern: str, columns: tuple[str, ...]) -> DataFrame:
    """All prediction files of a glob; each must have exactly these columns in this order, or reading fails."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    d = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').option("nullValue", "\x00").option("emptyValue", "").option("mode", "FAILFAST").csv(pattern)
    return d.na.fill("").withColumn("path", F.col("_metadata.file_path"))


def tolerant_json(c: Column, schema: str) -> Column:
    """A JSON text as a struct or array; null where it is missing or malformed."""
    return F.when(strict(c).isNotNull(), F.from_json(c, schema))


def read_review_rows(spark: SparkSession, pattern: str, columns: tuple[str, ...] | None = None, form: str = artifacts.AUTO) -> DataFrame:
    """All review rows of a glob of JSON files (arrays, objects or lines; with form `packed`, of tables of such files), every value a string; what is no object is left out."""
    return artifacts.strings(artifacts.read_artifacts(spark, pattern, form), columns)


def first_available(key: str, *sources: DataFrame) -> DataFrame:
    """Rows of the first source that has any row of a key, key by key; sources have the same columns."""
    out, seen = None, None
    for s in sources:
        new = s if seen is None else s.join(seen, key, "left_anti").select(s.columns)
        out = new if out is None else out.unionByName(new)
        keys = s.select(key).distinct()
        seen = keys if seen is None else seen.union(keys).distinct()
    return out
