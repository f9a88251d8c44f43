"""Validation: errors are a column of each row, never exceptions; splits are two filters."""

from __future__ import annotations

from pathlib import PurePath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions import text as T
from lodestream.operators import numbering
from lodestream.spec import FORBIDDEN_INPUTS, MISSING, REQUIRED


def supported(value: Column, evidence: Column) -> Column:
    """Whether each part of the value is in the evidence, with no digit or point beside it."""
    parts = F.transform(F.split(value, "-"), T.strip)
    return F.forall(parts, lambda p: (p != "") & T.has_number(evidence, p))


def value_is_number_or_range(value: Column) -> Column:
    parts = F.split(value, "-")
    return (value == MISSING) | ((F.size(parts) <= 2) & F.forall(parts, lambda p: T.is_number(T.strip(p))))


def missing_fields(fields: tuple[str, ...] = REQUIRED) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(f) == MISSING, F.lit(f)) for f in fields]))


def checked(records: DataFrame, fields: tuple[str, ...] = REQUIRED, strict_type: bool = False) -> DataFrame:
    """Adds `missing` and `error`: null where accepted, else the first reason against the row."""
    m = missing_fields(fields)
    error = F.when(F.size(m) > 0, F.concat(F.lit("missing required evidence-backed values: "), F.array_join(m, ", ")))
    if strict_type:  # rows that couldn't even be made
        error = F.when(~value_is_number_or_range(F.col("target_value")), "target_value must be a number, a numeric range, or NOT_DETECTED").when(F.size(m) > 0, F.concat(F.lit("missing required evidence-backed values: "), F.array_join(m, ", ")))
    error = error.when(T.blank(F.coalesce("evidence_text", F.lit(""))), "empty evidence text")
    error = error.when(~supported(F.col("target_value"), F.col("evidence_text")), F.concat(F.lit("target_value is not supported by evidence text: "), "target_value"))
    return records.withColumns({"missing": m, "error": error})


def judged(records: DataFrame, order: list[str], by: list[str] | None = None, strict_type: bool = False) -> DataFrame:
    """All rows with `missing`, `error` and, where rejected, `message`: `record {i}: ...`, counting all rows of a document from 0.
    The rows are written once on the way, so a document may have any number of them."""
    d = numbering.running_index(checked(records, strict_type=strict_type), by or ["source_file"], order, "record_index")
    return d.withColumn("message", F.when(F.col("error").isNotNull(), F.concat(F.lit("record "), "record_index", F.lit(": "), "error")))


def split(records: DataFrame, order: list[str], by: list[str] | None = None, strict_type: bool = False) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected ones with their messages; who needs both in one pass takes judged()."""
    d = judged(records, order, by, strict_type)
    return d.where("error is null").drop("error", "missing", "message"), d.where("error is not null")


_REPAIRED = ("compound_id", "smiles", "target_type", "target_relation", "target_value", "target_units", "bacteria", "evidence_id")
_VALUE = r"^\d+(?:\.\d+)?(?:\s*[-–]\s*\d+(?:\.\d+)?)?$"


def repaired(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """Model records made fit: gaps filled, types and relations fixed, values and structures held
    against their evidence; every change is a warning. evidence: evidence_id, source_text."""
    w: list[Column] = []
    d = items
    for f in _REPAIRED:
        gone = F.col(f).isNull() | (F.col(f).cast("string") == "")
        w.append(F.when(gone, F.lit(f"{f}_missing")))
        d = d.withColumn(f"raw_{f}", F.when(gone, MISSING).otherwise(F.col(f).cast("string")))
    kind, rel, val = F.col("raw_target_type"), F.col("raw_target_relation"), T.strip(F.col("raw_target_value"))
    ok_kind = kind.isin("MIC", "pMIC", MISSING)
    w.append(F.when(~ok_kind & (F.upper(kind) != "PMIC"), F.concat(F.lit("invalid_target_type:"), kind)))
    new_kind = F.when(F.upper(kind) == "PMIC", "pMIC").when(ok_kind, kind).otherwise(MISSING)
    short = rel.isin("<=", ">=")
    w += [F.when(short, F.concat(F.lit("relation_truncated:"), rel)), F.when(~short & ~rel.isin("=", "<", ">", MISSING), F.concat(F.lit("invalid_target_relation:"), rel))]
    new_rel = F.when(short, F.substring(rel, 1, 1)).when(rel.isin("=", "<", ">"), rel).otherwise(MISSING)
    dotted = F.replace(val, F.lit(","), F.lit("."))
    good = dotted.rlike(_VALUE)
    w += [F.when((val != MISSING) & good & (dotted != val), F.lit("target_value_decimal_comma_normalized")), F.when((val != MISSING) & ~good, F.concat(F.lit("suspicious_target_value:"), val))]
    new_val = F.when((val != MISSING) & good, F.translate(dotted, "– ", "-")).otherwise(val)
    e = evidence.select(F.col("evidence_id").alias("raw_evidence_id"), F.col("source_text").alias("ev_text"))
    before = F.coalesce("warnings", F.array().cast("array<string>")) if "warnings" in items.columns else F.array().cast("array<string>")
    d = d.withColumns({"w": F.concat(before, F.array_compact(F.array(*w))), "k": new_kind, "r": new_rel, "v": new_val}).join(e, "raw_evidence_id", "left")
    known = F.col("ev_text").isNotNull()
    lost = F.filter(F.split("v", "-"), lambda p: (p != "") & ~T.has_number(F.col("ev_text"), p))
    lost = F.when(known & (F.col("v") != MISSING), F.transform(lost, lambda p: F.concat(F.lit("target_value_not_found_in_evidence:"), p))).otherwise(F.array().cast("array<string>"))
    bad_smiles = known & (F.col("raw_smiles") != MISSING) & ~F.col("ev_text").contains(F.col("raw_smiles"))
    bare = (F.col("r") == MISSING) & (F.col("v") != MISSING)
    more = F.array_compact(F.array(F.when(~known, F.concat(F.lit("unknown_evidence_id:"), "raw_evidence_id"))))
    tail = F.array_compact(F.array(F.when(bad_smiles, F.lit("smiles_reset_to_not_detected_without_source_evidence")), F.when(bare, F.lit("target_relation_defaulted_to_equals"))))
    d = d.withColumns({"warnings": F.concat("w", more, lost, tail), "smiles": F.when(bad_smiles, MISSING).otherwise(F.col("raw_smiles")), "target_relation": F.when(bare, "=").otherwise(F.col("r")), "target_type": F.col("k"), "target_value": F.col("v")})
    d = d.withColumns({f: F.col(f"raw_{f}") for f in ("compound_id", "target_units", "bacteria", "evidence_id")})
    return d.drop("w", "k", "r", "v", "ev_text", *[f"raw_{f}" for f in _REPAIRED])


def schema_issues(candidates: DataFrame) -> DataFrame:
    """A row for each missing field of a candidate, and for a value that its evidence text lacks."""
    fields = ("compound_id", "target_type", "target_relation", "target_value", "target_units", "bacteria")
    issue = lambda f, s, m: F.struct(F.lit(f).alias("field"), F.lit(s).alias("status"), F.lit(m).alias("message"))
    each = [F.when(F.col(f) == MISSING, issue(f, "missing_value", f"{f} is NOT_DETECTED in raw candidate.")) for f in fields]
    each.append(F.when((F.col("target_value") != MISSING) & ~F.col("evidence_text").contains(F.col("target_value")), issue("target_value", "unsupported_value", "target_value is absent from the selected evidence text.")))
    return candidates.select("candidate_index", "evidence_id", F.explode(F.array_compact(F.array(*each))).alias("i")).select("candidate_index", "evidence_id", "i.*")


# Symbols of the line notation for structures
_ORGANIC = "Cl|Br|[BCNOPSFI]|[bcnops]|\\*"
_BRACKET = r"\[\d*(?:[A-Z][a-z]?|[a-z][a-z]?|\*)(?:@{1,2})?(?:H\d*)?(?:\++|-+|\+\d+|-\d+)?(?::\d+)?\]"
_RING, _BOND = r"%\d\d|\d", r"[-=#$:/\\]"
# end of the fixed values
_ATOM = rf"(?:{_BRACKET}|{_ORGANIC})"
_TOKEN = rf"{_BRACKET}|{_ORGANIC}|{_RING}|{_BOND}|[().]"
# classes of neighbours that can't be: what a bond, a branch, a dot or a ring number can't follow or precede
_MISPLACED = r"^[^A]|[B(.]$|B[^AR]|\([^AB]|\.[^A]|[B(.]\)"


def well_formed(smiles: Column) -> Column:
    """Whether a structure's text can be read: known atoms, bonds and branches in places they may have, branches
    that close in order, every ring number closed, and not on the atom that opened it. Null stays null.

    The text becomes one letter a token (A atom, R ring number, B bond; brackets and dots stay), so that places are
    judged by one pattern and nesting by a running depth, at any depth, in time linear in the text."""
    tokens = F.regexp_extract_all(smiles, F.lit(_TOKEN), F.lit(0))
    kind = lambda t: F.when(t.rlike(f"^{_ATOM}$"), "A").when(t.rlike(f"^(?:{_RING})$"), "R").when(t.isin("(", ")", "."), t).otherwise("B")

    def judged(known: Column) -> Column:
        classes = F.array_join(F.transform(known, lambda x: x["kind"]), "")
        # the depth after each token; below zero it stays there
        step = lambda depth, x: F.when(depth < 0, depth).when(x["kind"] == "(", depth + 1).when(x["kind"] == ")", depth - 1).otherwise(depth)
        rings = F.filter(known, lambda x: x["kind"] == "R")
        name = lambda x: F.regexp_replace(x["token"], "^%0?", "")
        numbers = F.array_sort(F.transform(rings, name))
        # sorted, open and closing numbers come in pairs of equals
        paired = F.forall(F.transform(numbers, lambda v, i: F.when(i % 2 == 0, v == F.coalesce(F.get(numbers, i + 1), F.lit(""))).otherwise(True)), lambda ok: ok)
        own = F.exists(F.transform(known, lambda x, i: (x["kind"] == "R") & F.coalesce((F.get(known, i - 1)["kind"] == "R") & (name(F.get(known, i - 1)) == name(x)), F.lit(False))), lambda bad: bad)
        return ~classes.rlike(_MISPLACED) & (F.aggregate(known, F.lit(0), step) == 0) & paired & ~own

    bound = F.transform(F.array(F.transform(tokens, lambda t: F.struct(t.alias("token"), kind(t).alias("kind")))), judged)
    whole = (smiles != "") & (F.array_join(tokens, "") == smiles)
    return F.when(smiles.isNotNull(), F.when(whole, F.get(bound, F.lit(0))).otherwise(False))


#: What `(?U)\\s` matches, written out: a class of Java's that is looked up, not asked of each character.
_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def structure_status(smiles: Column, parser: Column | None = None) -> Column:
    """What can be said of a structure string without a chemistry library; parser: a boolean column of one, such as well_formed()."""
    count = lambda c: F.length(smiles) - F.length(F.replace(smiles, F.lit(c), F.lit("")))
    last = F.lit("not_configured") if parser is None else F.when(parser, "valid").otherwise("invalid")
    return (
        F.when(smiles == MISSING, "not_applicable").when(smiles.contains("*") | smiles.contains("R") & smiles.rlike(r"(?U)(^|[^A-Za-z0-9])R\d*\b") | smiles.contains("Ar") & smiles.rlike(r"(?U)(^|[^A-Za-z0-9])Ar\b"), "generic_scaffold")
        .when(smiles.rlike(_SPACE) | (count("(") != count(")")) | (count("[") != count("]")), "invalid").otherwise(last)
    )


def refuse_forbidden(path: str) -> None:
    """Extraction must not read gold data or earlier outputs."""
    parts = {p.lower() for p in PurePath(path.replace("\\", "/")).parts}
    if bad := sorted(parts & FORBIDDEN_INPUTS):
        raise ValueError(f"extraction cannot read benchmark outputs or ground truth as input: {bad}")
