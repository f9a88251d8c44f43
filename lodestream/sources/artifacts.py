"""JSON artifacts that runs leave: a file holds an object, an array (indented or not) or lines, and says itself which.

A file all of whose lines are JSON is read by lines, any other whole.  Files up to a size are rows of one scan, in which each says
its form, so that any number of them costs the driver nothing beyond Spark's own listing.  Larger ones are read by lines, wherever
Spark splits them, where all their lines are JSON, else one row a file; the driver knows these by name, at most one for each such size of input.
Files too many to be made and opened one by one can lie packed as rows of a table (writers.write_packed), each still saying its form.
Values are VARIANT, so items of one file may differ; each row names its file, and what cannot be read is a row with an
error instead of a row less.  Spark's readers open every path."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import text as T
from lodestream.functions.json import fields, kind, plain_text, strict

AUTO, LINES, WHOLE, PACKED = "auto", "lines", "whole", "packed"


def _literal(path: str) -> str:
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(path))


def _exploded(texts: DataFrame, place: Column | None, free: Column | None = None) -> DataFrame:
    """texts: path, value. An array's items are numbered within it, an object is item 0, a line has its place (null for none).
    A line may be any value, and so may a text for which `free` is true."""
    at = F.lit(None).cast("long") if place is None else place
    loose = at.isNotNull() if free is None else at.isNotNull() | free
    d = texts.withColumn("v", strict(F.col("value"))).withColumn("kind", kind(F.col("v"))).withColumns({"at": at, "loose": loose})
    items = F.when(F.col("kind") == "ARRAY", F.try_variant_get("v", "$", "array<variant>")).when((F.col("kind") == "OBJECT") | F.col("loose") & F.col("kind").isNotNull(), F.array("v"))
    error = F.when(F.col("kind").isNull(), "not JSON").when(~F.col("kind").isin("ARRAY", "OBJECT") & ~F.col("loose"), "neither an object nor an array")
    d = d.withColumn("error", error).select("path", "error", "at", F.posexplode_outer(F.when(error.isNull(), items)).alias("i", "item")).where("item is not null or error is not null")
    return d.select("path", F.coalesce("at", F.col("i").cast("long")).alias("item_index"), "item", "error")


def _pieces(texts: DataFrame) -> DataFrame:
    """texts: path, value, a row a file. The file as what can be exploded: itself, or its lines with their places."""
    value = F.col("value")
    cut = F.split(F.regexp_replace(value, "^\ufeff", ""), r"\r\n|\n|\r")  # as Spark's reader of lines does
    piece = lambda x, at, free: F.struct(at.cast("long").alias("at"), x.alias("value"), free.alias("free"))
    numbered = lambda a: F.filter(F.transform(a, lambda x, i: piece(x, i, F.lit(True))), lambda p: T.strip(p["value"]) != "")
    itself = lambda free: F.array(piece(value, F.lit(None), free))
    by_lines = F.forall(cut, lambda x: strict(x).isNotNull() | (T.strip(x) == ""))
    some = F.exists(T.lines(value), lambda x: F.coalesce(kind(strict(x)) == "OBJECT", F.lit(False)))
    one_line = ~F.trim(value, F.lit(" \t\r\n")).rlike(r"[\r\n]")
    pieces = F.when(strict(value).isNotNull(), itself(one_line)).when(by_lines, numbered(cut)).when(some, numbered(T.lines(value))).otherwise(itself(F.lit(False)))
    return texts.select("path", F.explode(pieces).alias("p")).select("path", "p.*")


def _of_texts(texts: DataFrame) -> DataFrame:
    """texts: path, value, a row a file. The items of each by the form that its text has."""
    return _exploded(_pieces(texts.where(T.strip(F.col("value")) != "")), F.col("at"), F.col("free"))


def read_artifacts(spark: SparkSession, paths: str | Sequence[str], form: str = AUTO, columns: Sequence[str] | None = None, whole_bytes: int = 16 << 20) -> DataFrame:
    """path, item_index, item (VARIANT), error of all files. With form `packed` the paths are tables of files, a row each
    (path, value), of any form and read as files of up to `whole_bytes` are.

    item_index is the item's place in its array, 0 for a file's only object, and the place of a line among those of its
    file or its part of a file of more than `whole_bytes`, in ascending order but with gaps.  An empty file has no items.  columns: an object with other fields
    than these, more or fewer, is an error.  A file that is not JSON and has
    no line that is an object is one error; one that has such lines gives them, and an error for every other line."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = lambda p: spark.read.text(p).select(F.col("_metadata.file_path").alias("path"), "value").where(T.strip(F.col("value")) != "")
    whole = lambda p: spark.read.text(p, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").where(T.strip(F.col("value")) != "")
    place = F.monotonically_increasing_id()
    if form == LINES:
        got = _exploded(lines(paths).withColumn("at", place), F.col("at"))
    elif form == WHOLE:
        got = _exploded(whole(paths), None)
    elif form == AUTO:
        texts = spark.read.text(paths, wholetext=True).where(F.col("_metadata.file_size") <= whole_bytes).select(F.col("_metadata.file_path").alias("path"), "value")
        got = _of_texts(texts)
        large = sorted(r.path for r in spark.read.format("binaryFile").load(paths).where(F.col("length") > whole_bytes).select(F.col("_metadata.file_path").alias("path")).collect())
        by_name = [_literal(p) for p in large]
        odd = {_literal(r.path) for r in lines(by_name).where(strict(F.col("value")).isNull()).select("path").distinct().collect()} if large else set()
        if odd:
            d = whole(sorted(odd))
            one = strict(F.col("value")).isNotNull() | ~F.exists(T.lines(F.col("value")), lambda x: F.coalesce(kind(strict(x)) == "OBJECT", F.lit(False)))
            mixed = d.where(~one).select("path", F.posexplode(T.lines(F.col("value"))).alias("at", "value")).where(T.strip(F.col("value")) != "")
            got = got.unionByName(_exploded(d.where(one), None)).unionByName(_exploded(mixed.withColumn("at", F.col("at").cast("long")), F.col("at")))
        if rest := [p for p in by_name if p not in odd]:
            got = got.unionByName(_exploded(lines(rest).withColumn("at", place), F.col("at")))
    elif form == PACKED:
        got = _of_texts(spark.read.schema("path string, value string").parquet(*paths))
    else:
        raise ValueError(f"form must be one of {[AUTO, LINES, WHOLE, PACKED]}")
    if columns is not None:
        have, want = F.map_keys(fields(F.col("item"))), F.array(*map(F.lit, columns)).cast("array<string>")
        more, less = F.array_except(have, want), F.array_except(want, have)
        wrong = F.when(have.isNull(), "not an object").when(F.size(more) + F.size(less) > 0, F.concat(F.lit("columns differ: extra "), F.array_join(more, ","), F.lit("; missing "), F.array_join(less, ",")))
        got = got.withColumn("error", F.coalesce("error", F.when(F.col("item").isNotNull(), wrong)))
    return got


def stream_artifacts(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """read_artifacts() of files as they arrive in a folder, each read whole once."""
    d = spark.readStream.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
    return _exploded(d.select(F.col("_metadata.file_path").alias("path"), "value").where(T.strip(F.col("value")) != ""), None)


def typed(items: DataFrame, schema: str, on_error: str = "fail") -> DataFrame:
    """Objects as the columns of a schema (`name type, ...`), with path. Those that cannot be are an error that ends the job
    (`fail`), a row with `error` (`keep`), or left out (`drop`)."""
    if on_error not in ("fail", "keep", "drop"):
        raise ValueError("on_error must be fail, keep or drop")
    names = items.sparkSession.createDataFrame([], schema).schema
    d = items.withColumn("o", F.when(kind(F.col("item")) == "OBJECT", F.try_variant_get("item", "$", names.simpleString())))
    error = F.coalesce("error", F.when(F.col("o").isNull(), "does not fit the schema"))
    if on_error == "fail":
        d = d.where(F.when(error.isNotNull(), F.raise_error(F.concat("path", F.lit(": "), error))).otherwise(F.lit(True)))
    elif on_error == "drop":
        d = d.where(error.isNull())
    return d.select("path", *(["item_index", error.alias("error")] if on_error == "keep" else []), *[F.col("o")[n].alias(n) for n in names.names])


def strings(items: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Objects with every value as trimmed text, missing ones and nulls as empty; what is no object is left out. Without
    columns, all fields that any object has, by name."""
    m = items.where(F.col("error").isNull()).select(fields(F.col("item")).alias("m")).where("m is not null")
    if columns is None:
        columns = sorted(r.k for r in m.select(F.explode(F.map_keys("m")).alias("k")).distinct().collect())  # names of columns
    return m.select(*[T.clean(plain_text(F.try_element_at("m", F.lit(c)))).alias(c) for c in columns])
