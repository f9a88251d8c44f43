"""Operator 13: exact duplicates by a tree-merge of sorted digest runs, in DataFrame functions alone.

Each input partition is a slot and makes one sorted run of its digests, with the smallest identifier and the number of
rows of each.  In round r the slots that differ in digit r (base FAN) exchange their runs: a digest goes to the one
whose digit r is the digest's own, where FAN sorted runs at most are merged into one.  After all rounds, log of the
number of slots, a digest is in one run, and every run has its part of all digests, so no task ever holds what
grows with the table.  The way back is the same tree: a run of each round learns from the next one which identifier
stays and how many there are, down to the rows, which meet their own slot's run.  A group of copies is cut down to a row a
slot before anything is sent and is spread over the slots on the way back, however large it is.

Texts count as equal when SHA-256, length and a second hash of their normal forms agree, at every level; a digest that
meets another length or second hash is another run entry.  In a normal form each run of blanks and U+0009..U+000D
is one blank.

Defined results: null texts are empty; of equal texts the row with the smallest doc_id stays, rows without doc_id come
last, and of rows that share it one stays; keep_id is null where no row of a group has a doc_id; very long texts
are hashed whole; an empty table gives an empty one; further columns are ignored by groups() and kept by drop_copies()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import Stored, require

#: Runs merged at once, and slots that exchange runs in a round.
FAN = 16
_KEY = ["digest", "n_bytes", "second"]


def normal_text(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _digests(c: Column) -> list[Column]:
    t = normal_text(c).cast("binary")
    return [F.unhex(F.sha2(t, 256)).alias("digest"), F.octet_length(t).alias("n_bytes"), F.xxhash64(t).alias("second")]


def _address(slot: Column, done: int, rounds: int) -> Column:
    """The slot of a digest after `done` rounds: so many digits are its own, the others those of the slot it came from."""
    own = F.pmod(F.xxhash64("second", "n_bytes"), F.lit(FAN**rounds))
    return (slot - slot % FAN**done + own % FAN**done).cast("long")


def _merged(rows: DataFrame, who: Column, n: Column) -> DataFrame:
    """One sorted run of each slot."""
    return rows.groupBy("slot", *_KEY).agg(F.min(who).alias("who"), F.sum(n).alias("n"))


def _resolved(rows: DataFrame, name: str) -> DataFrame:
    """rows: doc_id, digests, slot, tag (its own for every row). Adds keep (isnull, doc_id, tag) and group_size."""
    slots = (rows.agg(F.max("slot")).first()[0] or 0) + 1
    rounds = 1
    while FAN**rounds < slots:
        rounds += 1
    runs = [Stored(_merged(rows, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag"), F.lit(1)), f"{name}-run").df]
    for r in range(1, rounds + 1):
        runs.append(Stored(_merged(runs[-1].withColumn("slot", _address(F.col("slot"), r, rounds)), F.col("who"), F.col("n")), f"{name}-run").df)
    found = runs[-1].withColumnsRenamed({"who": "keep", "n": "group_size", "slot": "up"})
    for r in range(rounds, 0, -1):
        below = runs[r - 1].select("slot", *_KEY).withColumn("up", _address(F.col("slot"), r, rounds))
        found = below.join(found, ["up", *_KEY]).select(F.col("slot").alias("up"), *_KEY, "keep", "group_size")
    return rows.join(found.withColumnRenamed("up", "slot"), ["slot", *_KEY])


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs (doc_id, text)."""
    require(docs, "doc_id", "text")
    # written once, so that slots and tags stay what they are
    rows = Stored(docs.select("doc_id", *_digests(F.col("text")), F.spark_partition_id().cast("long").alias("slot"), F.monotonically_increasing_id().alias("tag")), "exact-rows").df
    return _resolved(rows, "exact").select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("tag") == F.col("keep.tag")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, whole."""
    require(docs, "doc_id", "text")
    tag = "tag"
    while tag in docs.columns:
        tag += "_"
    whole = Stored(docs.withColumn(tag, F.monotonically_increasing_id()).withColumn(tag, F.struct(F.spark_partition_id().cast("long").alias("slot"), F.col(tag).alias("tag"))), "exact-whole").df
    rows = whole.select("doc_id", *_digests(F.col("text")), F.col(f"{tag}.slot").alias("slot"), F.col(f"{tag}.tag").alias("tag"))
    kept = _resolved(rows, "exact").where("tag = keep.tag").select(F.struct("slot", "tag").alias(tag))
    return whole.join(kept, tag, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
