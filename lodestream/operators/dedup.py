"""Deduplication by evidence, conflicts, and the link of a record to its source passage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions import text as T
from lodestream.operators import numbering
from lodestream.spec import MISSING, NOT_AVAILABLE, RECORD_COLUMNS, TABLE_LIKE


def merged(records: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """One row of each set of equal rows with one evidence id: the first, with all warnings in order
    of appearance, and how many there were. `by`: further key columns, such as the document."""
    key = [*(by or []), *RECORD_COLUMNS, "evidence_id"]
    at = F.struct(*order)
    rest = [c for c in records.columns if c not in key and c != "warnings"]
    agg = records.groupBy(*key).agg(*[F.min_by(c, at).alias(c) for c in rest], F.count("*").alias("duplicate_count"))
    # each warning's first place comes before they are gathered, so that a row holds distinct ones alone
    each = records.select(*key, at.alias("at"), F.posexplode("warnings").alias("pos", "w")).groupBy(*key, "w").agg(F.min(F.struct("at", "pos")).alias("first"))
    noted = each.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("first", "w"))).alias("noted"))
    warnings = F.coalesce(F.transform("noted", lambda n: n["w"]), F.array().cast("array<string>"))
    return _null_safe(agg, noted, key, "left").withColumn("warnings", warnings).drop("noted")


def conflict_members(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each distinct row (`row`, with `n_same` copies) of every key (compound, type, organism; none missing)
    that has more than one, and `n_rows`, how many distinct rows its key has.

    Copies are summed on the map side, then distinct rows by key; the members take their key's number by a join
    against one row a key. No list of a key's rows is ever made, so a key may hold any share of all rows."""
    key = [*(by or []), "compound_id", "target_type", "bacteria"]
    known = ~F.array_contains(F.array("compound_id", "target_type", "bacteria"), MISSING)
    rows = records.where(known).groupBy(*key, F.concat_ws("|", *RECORD_COLUMNS).alias("row")).agg(F.count("*").alias("n_same"))
    return _null_safe(rows, rows.groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1"), key)


def conflicts(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """conflict_members() as one row a key with a list of its rows, for reports on keys of few rows."""
    key = [*(by or []), "compound_id", "target_type", "bacteria"]
    known = ~F.array_contains(F.array("compound_id", "target_type", "bacteria"), MISSING)
    rows = F.array_sort(F.collect_set(F.concat_ws("|", *RECORD_COLUMNS)))
    return records.where(known).groupBy(*key).agg(rows.alias("rows")).where(F.size("rows") > 1)


def conflict_count(records: DataFrame, by: list[str]) -> DataFrame:
    """Number of keys per group whose relation, value or unit differ."""
    one = records.groupBy(*by, "compound_id", "target_type", "bacteria").agg(F.count_distinct("target_relation", "target_value", "target_units").alias("n"))
    return one.where("n > 1").groupBy(*by).agg(F.count("*").alias("conflict_count"))


def candidate_members(candidates: DataFrame, index: str = "candidate_index") -> DataFrame:
    """kind, key, first, index: a `duplicate` row for each repeat beside the first like it, and a `conflict` row
    for each member of a key (missing values included) whose measurements differ, beside the key's first.

    Both come from grouped minima joined back, one row a key, so no key's members meet in a list or a window."""
    key = ["compound_id", "target_type", "target_relation", "target_value", "target_units", "bacteria"]
    wide = ["compound_id", "target_type", "bacteria"]
    candidates = candidates.select(*key, index)
    dup = _null_safe(candidates, candidates.groupBy(*key).agg(F.min(index).alias("first"), F.count("*").alias("n")).where("n > 1"), key).where(F.col(index) > F.col("first"))
    unlike = candidates.groupBy(*wide).agg(F.min(index).alias("first"), F.count_distinct("target_relation", "target_value", "target_units").alias("n")).where("n > 1")
    shown = lambda d, kind, k: d.select(F.lit(kind).alias("kind"), F.concat_ws("|", *k).alias("key"), "first", F.col(index).alias("index"))
    return shown(dup, "duplicate", key).unionByName(shown(_null_safe(candidates, unlike, wide), "conflict", wide))


def candidate_conflicts(candidates: DataFrame, index: str = "candidate_index") -> DataFrame:
    """candidate_members() as a supervisor's report has them: [first index, this index] for each repeat, and one
    row with all indexes of a key whose measurements differ (for keys of few members)."""
    wide = ["compound_id", "target_type", "bacteria"]
    dup = candidate_members(candidates, index).where("kind = 'duplicate'").select("kind", F.array("first", "index").alias("indexes"), "key")
    m = candidates.groupBy(*wide).agg(F.array_sort(F.collect_list(index)).alias("indexes"), F.count_distinct("target_relation", "target_value", "target_units").alias("n"))
    return dup.unionByName(m.where("n > 1").select(F.lit("conflict").alias("kind"), "indexes", F.concat_ws("|", *wide).alias("key")))


def duplicate_status(rows: DataFrame, key: tuple[str, ...] = RECORD_COLUMNS, evidence: str = "evidence_id", text: str = "source_text") -> DataFrame:
    """Adds duplicate_count and duplicate_status.

    Counts come from grouped sums joined back, so that a key with many rows is summed on the map
    side and its rows need not meet in one task."""
    same = [*key, evidence, text]
    fine = rows.groupBy(*same).agg(F.count("*").alias("n_same"))
    wide = fine.groupBy(*key).agg(F.sum("n_same").alias("n_key"), F.count_distinct(evidence).alias("n_evidence"))
    d = _null_safe(_null_safe(rows, fine, same), wide, list(key))
    status = (
        F.when(F.col("n_same") > 1, "duplicate_same_evidence").when((F.col("n_key") > 1) & (F.col("n_evidence") > 1), "repeated_distinct_evidence")
        .when(F.col("n_key") > 1, "duplicate_chemx_row").otherwise("unique")
    )
    return d.withColumns({"duplicate_count": F.col("n_key").cast("string"), "duplicate_status": status}).drop("n_same", "n_key", "n_evidence")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    r = right.select(*[F.col(k).alias(f"r_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(r[f"r_{i}"]) for i, k in enumerate(keys)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(r, cond, how).drop(*[f"r_{i}" for i in range(len(keys))])


def duplicate_diagnostics(rows: DataFrame, key: tuple[str, ...] = RECORD_COLUMNS, evidence: str = "evidence_id", text: str = "source_text") -> DataFrame:
    """One row: surplus copies by row, by row and evidence, and rows repeated over several evidences."""
    fine = rows.groupBy(*key, evidence, text).agg(F.count("*").alias("n"))
    wide = fine.groupBy(*key).agg(F.sum("n").alias("n"), F.count_distinct(evidence).alias("e"), F.sum(F.col("n") - 1).alias("s"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return wide.agg(zero(F.sum(F.col("n") - 1)).alias("exact_duplicate_rows"), zero(F.sum("s")).alias("duplicates_with_same_evidence"), zero(F.sum(F.when(F.col("e") > 1, F.col("n")))).alias("repeated_with_other_evidence"))


def evidence_id(*fields: Column) -> Column:
    """A stable id: `ev:` and twelve hex digits of the SHA-1 of the fields, null as empty."""
    return F.concat(F.lit("ev:"), F.substring(F.sha1(F.concat_ws("|", *[T.clean(f) for f in fields]).cast("binary")), 1, 12))


_DASH = "[-–—]"


def _label(c: Column) -> Column:
    return F.regexp_replace(F.lower(T.strip(c)), "[–—]", "-")


def compound_mention(compound: Column, text: Column) -> Column:
    """How the passage names the compound: as a table line's first cell, within a letter range, or in a phrase."""
    label = T.strip(F.coalesce(compound, F.lit("")))
    body = F.coalesce(text, F.lit(""))
    first = F.transform(F.filter(F.transform(T.lines(body), T.strip), lambda x: x != ""), lambda x: F.regexp_replace(F.element_at(F.split(x, r"(?U)\s+|\|", 2), 1), r"^[()\[\],:;]+|[()\[\],:;]+$", ""))
    cell = F.get(F.filter(first, lambda x: _label(x) == _label(label)), F.lit(0))
    number, letter = F.regexp_extract(label, r"^(\d+)([A-Za-z])$", 1), F.regexp_extract(label, r"^(\d+)([A-Za-z])$", 2)
    ranged = F.concat(F.lit(r"(?iuU)\bcompounds?\s+"), number, F.lit(rf"([A-Za-z])\s*{_DASH}\s*"), number, F.lit(r"([A-Za-z])\b"))
    hits = F.arrays_zip(*[F.regexp_extract_all(body, ranged, F.lit(g)).alias(n) for g, n in ((0, "all"), (1, "a"), (2, "b"))])
    inside = F.get(F.filter(hits, lambda h: T.letter_between(letter, h["a"], h["b"])), F.lit(0))["all"]
    in_range = F.when(label.rlike(r"^\d+[A-Za-z]$"), T.collapse(F.when(inside != "", inside)))
    pieces = F.array_join(F.transform(F.split(label, _DASH), T.quote), _DASH)
    phrase = [
        F.concat(F.lit(r"(?iuU)\bbenzimidazole\s+derivative\s*\(?\s*"), pieces, F.lit(r"\s*\)?")), F.concat(F.lit(r"(?iuU)\bderivative\s*\(?\s*"), pieces, F.lit(r"\s*\)?")),
        F.concat(F.lit(r"(?iuU)\bcompounds?\s+(?:no\.?\s*)?\(?\s*"), pieces, F.lit(r"\s*\)?")), F.concat(F.lit(r"(?iuU)\bseries\s+"), pieces, F.lit(r"\b")),
    ]
    said = [F.when(F.regexp_like(body, p), T.collapse(T.extract(body, p))) for p in phrase]
    none = (label == "") | (label == MISSING) | (body == "")
    return F.when(none, NOT_AVAILABLE).otherwise(F.coalesce(cell, F.when(in_range != "", in_range), *said, F.lit(NOT_AVAILABLE)))


def snippet(text: Column, compound: Column, value: Column, limit: int = 1200) -> Column:
    """At most `limit` characters around the first of compound and value that occurs."""
    t = T.collapse(text)
    pos = lambda a: F.when((a != "") & (a != MISSING) & F.lower(t).contains(F.lower(a)), F.call_function("instr", F.lower(t), F.lower(a)) - 1)
    center = F.coalesce(pos(compound), pos(value), F.lit(0))
    end = F.least(F.length(t), F.greatest(center - limit // 3, F.lit(0)) + limit)
    start = F.greatest(end - limit, F.lit(0))
    cut = F.trim(F.substring(t, start + 1, end - start))
    shown = F.concat(F.when(start > 0, "...").otherwise(""), cut, F.when(end < F.length(t), "...").otherwise(""))
    return F.when(F.length(t) <= limit, t).otherwise(shown)


def source_kind(row_id: Column, table_id: Column, text: Column) -> Column:
    return F.when((row_id == TABLE_LIKE) | (table_id == TABLE_LIKE), TABLE_LIKE).when(T.clean(table_id) != "", "table").when(T.clean(text) != "", "text").otherwise(NOT_AVAILABLE)


def raw_or_normal(raw: Column, source: Column, normal: Column) -> Column:
    pick = lambda c: F.when(T.clean(c) != "", T.clean(c))
    return F.coalesce(pick(raw), pick(source), F.when(F.coalesce(normal, F.lit("")) != "", normal), F.lit(NOT_AVAILABLE))


def link_evidence(records: DataFrame, evidence: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Adds evidence_text and the like to records by evidence_id; `rule-N` looks at the N-th rule record
    (rules: rule_index from 0); else the first of merged_evidence, if there is such a column.
    Evidence and rules are joined, since they may be as many as the records."""
    fields = [c for c in evidence.columns if c != "evidence_id"]
    d = records.join(evidence.select("evidence_id", F.struct(*fields).alias("ev")), "evidence_id", "left")
    options = ["ev"]
    if rules is not None:
        n = F.when(F.col("evidence_id").rlike(r"^rule-\d+$"), F.substring("evidence_id", 6, 20).try_cast("long") - 1)
        r = rules.select(F.col("rule_index").alias("rule_index"), F.struct(*fields).alias("rule_ev"))
        d = d.withColumn("rule_index", n).join(r, "rule_index", "left").drop("rule_index")
        options.append("rule_ev")
    if "merged_evidence" in records.columns:
        d = d.withColumn("merged_ev", F.get("merged_evidence", F.lit(0)))
        options.append("merged_ev")
    return d.withColumn("linked", F.coalesce(*options)).drop(*options).select("*", *[F.col(f"linked.{f}").alias(f) for f in fields]).drop("linked")


def as_rule_records(records: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """Rule records as model records: ids `rule-1`, `rule-2` ... within each document, no warnings yet."""
    d = numbering.running_index(records, by, order, "evidence_id")
    return d.withColumn("evidence_id", F.concat(F.lit("rule-"), F.col("evidence_id") + 1)).withColumn("warnings", F.array().cast("array<string>"))


def review_rows(records: DataFrame) -> DataFrame:
    """The review table: identity, seven columns, source, mention, raw and normal values, duplicate status."""
    d = records.withColumn("text", F.coalesce("evidence_text", F.lit("")))
    have = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("string")
    eid = F.when(T.clean(have("evidence_id")) != "", have("evidence_id")).otherwise(evidence_id(*[F.col(c) for c in ("source_file", "page", "section", "table_id", "row_id", "text")]))
    mention = compound_mention(F.col("compound_id"), F.col("text"))
    d = d.select(
        F.col("source_file").alias("pdf"), T.file_stem(F.col("source_file")).alias("article_id"), *RECORD_COLUMNS, T.clean(F.col("page")).alias("page"), eid.alias("evidence_id"),
        source_kind(F.col("row_id"), F.col("table_id"), F.col("text")).alias("source_kind"), snippet(F.col("text"), F.col("compound_id"), F.col("target_value")).alias("source_text"),
        mention.alias("compound_mention"), F.when(mention == NOT_AVAILABLE, NOT_AVAILABLE).otherwise("found").alias("compound_label_found"),
        T.clean(F.col("extraction_method")).alias("extractor"), T.clean(F.col("confidence")).alias("confidence"),
        raw_or_normal(have("raw_value"), have("source_value"), F.col("target_value")).alias("raw_value"), raw_or_normal(have("raw_units"), have("source_units"), F.col("target_units")).alias("raw_units"),
        F.col("target_value").alias("normalized_value"), F.col("target_units").alias("normalized_units"),
    )
    return duplicate_status(d).withColumn("value_mismatch", F.lit("no"))
