"""Recorded model answers in place of a live model: batching, parsing, selection, status."""

from __future__ import annotations

from pathlib import PurePath

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.json import fields, kind, plain_text, strict
from lodestream.operators import dedup, validate
from lodestream.spec import MISSING, RECORD_COLUMNS


def batches(evidence: DataFrame, size: int, by: list[str], order: list[str]) -> DataFrame:
    """Adds batch (from 0) of `size` rows each within a document."""
    if size < 1:
        raise ValueError("a batch has one row at least")
    return evidence.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size).cast("int"))


def pending(batches_: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Batches with no stored answer yet."""
    return batches_.join(done.select(*keys).distinct(), keys, "left_anti")


def combined_status(status: str = "status") -> Column:
    """One status for several batches; none at all counts as live."""
    s = F.collect_set(status)
    only = lambda *x: F.size(F.array_except(s, F.array(*map(F.lit, x)))) == 0
    return (
        F.when(only("live", "cached_live"), "live").when(only("disabled"), "disabled").when(only("replay", "cached_live"), "replay")
        .when(F.array_contains(s, "live"), "partial_live").when(F.array_contains(s, "llm_error"), "llm_error").otherwise(F.array_join(F.array_sort(s), ","))
    )


#: What an item of an answer may say of type and relation.
_ONE_OF = {"target_type": ("MIC", "pMIC", MISSING), "target_relation": ("=", "<", ">", MISSING)}


def _items(v: Column) -> Column:
    """Of an answer's JSON value, the items (array<variant>) where it is an array or an object that has one as `records`."""
    held = F.coalesce(F.try_variant_get(v, "$.records", "variant"), v)
    return F.when(kind(held) == "ARRAY", F.try_variant_get(held, "$", "array<variant>"))


_FIELDS = (*RECORD_COLUMNS, "evidence_id")


def _item(m: Column) -> Column:
    """The known fields of an object (map<string,variant>) as texts."""
    return F.struct(*[plain_text(F.try_element_at(m, F.lit(c))).alias(c) for c in _FIELDS])


def _problem(name: Column, v: Column) -> Column:
    """What is wrong with a field that an item has; null for a good one. target_value may be anything."""
    out = F.when(~name.isin(*_FIELDS, "warnings"), F.concat(name, F.lit(": no such field")))
    out = out.when(name == "warnings", F.when((kind(v) != "ARRAY") | ~F.forall(F.try_variant_get(v, "$", "array<variant>"), lambda w: kind(w) == "STRING"), "warnings: not a list of texts"))
    out = out.when((name != "target_value") & (kind(v) != "STRING"), F.concat(name, F.lit(": not a text")))
    for c, allowed in _ONE_OF.items():
        out = out.when((name == c) & ~F.try_variant_get(v, "$", "string").isin(*allowed), f"{c}: none of {', '.join(allowed)}")
    return out


def parse_lenient(responses: DataFrame, response: str = "response") -> DataFrame:
    """Items of an array or of `{"records": [...]}`, each judged by itself; an answer of another shape gives a warning row.

    Columns: those of responses, item_index, item (struct of texts; null with a warning), warning, item_warnings (the item's own, and
    `target_relation_missing` where it has a value without one).  A bad item (no object, an unknown field, a field that is no
    text, a type or relation that isn't known) is a row with the warning `record {index}: ...`, and the others stay.
    target_value may be anything: a number as Python writes it, nested values as JSON.  A field that an item lacks is null.
    Objects that name a field twice are not JSON here."""
    d = responses.withColumn("v", strict(F.col(response)))
    d = d.withColumn("items", _items(F.col("v"))).withColumn("warning", F.when(F.col("v").isNull(), "Invalid JSON response").when(F.col("items").isNull(), "LLM response must be a JSON array."))
    d = d.select(*responses.columns, "warning", F.posexplode_outer("items").alias("item_index", "x")).where("x is not null or warning is not null").withColumn("m", fields(F.col("x")))
    bad = F.filter(F.transform(F.map_entries("m"), lambda e: _problem(e["key"], e["value"])), lambda p: p.isNotNull())
    d = d.withColumn("problems", F.when(F.col("m").isNull(), F.array(F.lit("not an object"))).otherwise(bad))
    d = d.withColumn("warning", F.coalesce("warning", F.when(F.size("problems") > 0, F.concat(F.lit("record "), "item_index", F.lit(": "), F.array_join("problems", "; ")))))
    good = F.col("warning").isNull()
    d = d.withColumn("item", F.when(good, _item(F.col("m"))))
    said = F.coalesce(F.nullif(F.col("item.target_value"), F.lit("")), F.lit(MISSING)) != MISSING
    none = F.array().cast("array<string>")
    own = F.coalesce(F.try_variant_get(F.try_element_at("m", F.lit("warnings")), "$", "array<string>"), none)
    bare = F.when(said & (F.coalesce(F.col("item.target_relation"), F.lit(MISSING)) == MISSING), F.array(F.lit("target_relation_missing"))).otherwise(none)
    return d.select(*responses.columns, "item_index", "item", "warning", F.when(good, F.concat(own, bare)).alias("item_warnings"))


def payload_items(answers: DataFrame, payload: str = "payload") -> DataFrame:
    """The columns of answers, item_index and item (struct of texts, whatever they were) of each object among a payload's items;
    item is null once for a payload that can be read and has none."""
    d = answers.withColumn("v", strict(F.col(payload))).withColumn("objects", F.filter(_items(F.col("v")), lambda x: kind(x) == "OBJECT")).where("objects is not null")
    d = d.select(*answers.columns, F.posexplode_outer("objects").alias("item_index", "x")).withColumn("m", fields(F.col("x")))
    return d.select(*answers.columns, "item_index", F.when(F.col("m").isNotNull(), _item(F.col("m"))).alias("item"))


def parse_strict(responses: DataFrame, response: str = "response", text: str = "text") -> DataFrame:
    """Items of array answers whose every value is in the chunk's text; one bad item rejects its answer whole: one that is no
    object, or has a field that is no text. A missing target_value is the text that stands for missing ones."""
    d = responses.withColumn("v", strict(F.col(response))).withColumn("items", F.when(kind(F.col("v")) == "ARRAY", F.transform(F.try_variant_get("v", "$", "array<variant>"), lambda x: fields(x))))

    def fine(m: Column) -> Column:
        texts = F.forall(F.map_entries(m), lambda e: ~e["key"].isin(*RECORD_COLUMNS) | (kind(e["value"]) == "STRING"))
        value = F.coalesce(F.try_variant_get(F.try_element_at(m, F.lit("target_value")), "$", "string"), F.lit(MISSING))
        return F.coalesce(texts & (value != "") & F.contains(F.col(text), value), F.lit(False))

    d = d.withColumn("valid", F.coalesce(F.forall("items", fine), F.lit(False)))
    return d.select(*responses.columns, "valid", F.posexplode_outer(F.when(F.col("valid"), F.transform("items", lambda m: _item(m)))).alias("item_index", "item"))


def replay_file(folder: str | None, name: str, suffix: str = ".json") -> str | None:
    """Where the recorded answer of a document lies: its name without folder and ending; none without a folder."""
    if not folder:
        return None
    stem = PurePath(name.replace("\\", "/")).stem
    return f"{folder.rstrip('/')}/{stem}{suffix}"


def run_batches(answers: DataFrame, records: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Records of each batch, repaired against that batch's own evidence: of its payload where that can be
    read, else those parsed before. answers: keys, payload; records: keys and an item's fields; evidence:
    keys, evidence_id, source_text. `origin` says which; a batch without either gives no row."""
    read = payload_items(answers.select(*keys, "payload")).drop("payload")
    got = read.where("item is not null").select(*keys, "item.*", F.lit("payload").alias("origin"))
    rest = records.join(read.select(*keys).distinct(), keys, "left_anti").select(*got.columns[:-1], F.lit("records").alias("origin"))
    here = lambda c: F.to_json(F.struct(*keys, c))  # noqa: E731  an evidence id counts within its batch only
    own = evidence.select(here(F.col("evidence_id").alias("id")).alias("evidence_id"), "source_text")
    d = got.unionByName(rest).withColumn("plain_id", F.coalesce("evidence_id", F.lit("")))
    d = validate.repaired(d.withColumn("evidence_id", F.when(F.col("plain_id") != "", here(F.col("plain_id").alias("id")))), own)
    shown = lambda w: F.when(w.startswith("unknown_evidence_id:"), F.concat(F.lit("unknown_evidence_id:"), F.when(F.col("plain_id") != "", F.col("plain_id")).otherwise(MISSING))).otherwise(w)
    return d.withColumns({"warnings": F.transform("warnings", shown), "evidence_id": F.when(F.col("plain_id") != "", F.col("plain_id")).otherwise(MISSING)}).drop("plain_id")


def select_by_index(chunks: DataFrame, replay: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Chunks at the recorded indexes (from 0), in the recorded order; those out of range are dropped.
    replay: by, indexes array<int>."""
    n = chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    want = replay.select(*by, F.posexplode("indexes").alias("replay_ord", "chunk_index"))
    return want.join(n, [*by, "chunk_index"])


def extractor_counts(parsed: DataFrame, by: list[str]) -> DataFrame:
    """Answers, valid answers and records of each document."""
    one = parsed.groupBy(*by, "chunk_index").agg(F.max("valid").alias("valid"), F.count("item").alias("n"))
    return one.groupBy(*by).agg(F.count("*").alias("responses"), F.count_if(F.col("valid")).alias("valid_responses"), F.sum("n").alias("records"))


def candidates(planned: DataFrame, replay: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recorded candidates with their planned evidence, and issue rows for those that name none."""
    d = replay.join(planned.select("evidence_id", F.col("text").alias("evidence_text"), "source_file", "page"), "evidence_id", "left")
    lost = d.where("evidence_text is null").select("candidate_index", "evidence_id", F.lit("evidence_id").alias("field"), F.lit("unknown_evidence").alias("status"), F.lit("Candidate evidence is not among the planned evidence.").alias("message"))
    return d.where("evidence_text is not null"), lost


def supervise(planned: DataFrame, replay: DataFrame, parser: Column | None = None) -> dict[str, DataFrame]:
    """Plan to candidates, schema issues, structure checks and conflicts."""
    found, lost = candidates(planned, replay)
    filled = found.fillna(MISSING, list(RECORD_COLUMNS))
    return {
        "candidates": filled, "issues": lost.unionByName(validate.schema_issues(filled)),
        "structures": filled.select("candidate_index", "smiles", validate.structure_status(F.col("smiles"), parser).alias("status")), "conflicts": dedup.candidate_conflicts(filled),
    }


def options_from(env: dict[str, str], prefix: str = "LODESTREAM_") -> dict[str, str]:
    """Settings named `prefix...`, lower-cased, without empty ones."""
    return {k[len(prefix) :].lower(): v for k, v in env.items() if k.startswith(prefix) and v}


def live(*_: object) -> None:
    raise NotImplementedError("only recorded answers are supported")
