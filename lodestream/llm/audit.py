"""Operator 12: how filters interact, by a relational word pipeline.

Five filters judge a text: A few words, B few distinct ones, C many capitals, D a symbol of a set, E a text that a
smaller doc_id has.  A to D depend on the text alone, so of equal texts one row is read: its words are exploded,
aggregated by (document, word) and then by document, where the totals and the distinct ones appear.  The other flags
are outer-joined, and each part's rows are aggregated into 32 conditional counts, one for each set of filters failed, and as many
for the rows labelled good and toxic.  All orders and steps follow from these counts.

The rows but for their texts are written once, counted by (digest, part, labels, doc_id), so copies meet as counts; the texts
are dealt by (digest, doc_id), which is spread however many copies a text has, and the words need no other exchange.

Defined results: null texts are empty and have no words; a null part is the empty string; equal texts are those of one SHA-256;
a row without doc_id has no label, never fails E and makes no other fail it; repeated rows of one doc_id and text count
each, and don't fail E by one another; labels repeated for a doc_id count if any of them is 1; very long texts are
read whole, each in one task; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import WORD, Stored, pieces, require

FILTERS = "ABCDE"
#: Compressed bytes of texts whose words meet in one task.
PART_BYTES = 3 << 20


def _word_totals(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """h, words, distinct_words of the texts that reps (h, id, m: rows that hold it) names."""
    n = pieces(docs, PART_BYTES)
    texts = docs.select(_digest(F.col("text")).alias("h"), _id().alias("id"), "text").repartition(n, "h", "id")
    words = texts.join(reps.hint("shuffle_hash"), ["h", "id"]).select("h", "id", "m", F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word"))
    by_word = words.groupBy("h", "id", "m", "word").agg(F.count("*").alias("n"))
    return by_word.groupBy("h", "id", "m").agg(F.sum("n").alias("n"), F.count("*").alias("distinct_words")).select("h", (F.col("n") / F.col("m")).cast("long").alias("words"), "distinct_words")


def _digest(text: Column) -> Column:
    return F.coalesce(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), F.lit(b""))  # never null, so that joins don't test it anew


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def failures(docs: DataFrame, labels: DataFrame, part: str = "lang", least_words: int = 200, distinct_percent: int = 50, capital_percent: int = 3, symbols: str = "#$%&*|") -> DataFrame:
    """part, good, toxic, mask (bit i: filter i failed), n: the rows of docs counted by what they fail."""
    require(docs, "doc_id", "text", part)
    require(labels, "doc_id", "quality", "toxic")
    text = F.coalesce("text", F.lit(""))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    seen = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), _digest(F.col("text")).alias("h"), (100 * capitals > capital_percent * F.length(text)).alias("c"), (F.length(F.translate(text, symbols, "")) < F.length(text)).alias("d"))
    flag = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    no = F.lit(False)
    named = seen.where("doc_id is not null").join(marks, "doc_id", "left").withColumns({"good": F.coalesce("quality", no), "toxic": F.coalesce("toxic", no)}).drop("quality")
    nameless = seen.where("doc_id is null").withColumns({"good": no, "toxic": no})
    rows = Stored(named.unionByName(nameless).groupBy("h", "part", "good", "toxic", "doc_id", "c", "d").agg(F.count("*").alias("m")), "audit-rows").df
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "m")
    first = rows.groupBy("h", "doc_id").agg(F.sum("m").alias("m")).groupBy("h").agg(F.min(least).alias("first")).select("h", F.col("first.doc_id").alias("first_id"), F.col("first.m").alias("m"))
    totals = _word_totals(docs, first.select("h", F.coalesce(F.col("first_id").cast("string"), F.lit("")).alias("id"), "m"))
    kinds = rows.groupBy("h", "part", "good", "toxic", "c", "d").agg(F.sum("m").alias("n"), F.min(least).alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("m")).otherwise(0)).alias("loose"))
    d = kinds.join(first.select("h", "first_id"), "h").join(totals, "h", "left").na.fill(0, ["words", "distinct_words"])
    bits = (F.col("words") < least_words).cast("int") + 2 * (100 * F.col("distinct_words") < distinct_percent * F.col("words")).cast("int") + 4 * F.col("c").cast("int") + 8 * F.col("d").cast("int")
    original = F.col("loose") + F.when(F.col("least.doc_id") == F.col("first_id"), F.col("least.m")).otherwise(0)  # rows that no smaller doc_id copies
    both = F.array(F.struct(bits.alias("mask"), original.alias("n")), F.struct((bits + 16).alias("mask"), (F.col("n") - original).alias("n")))
    return d.select("part", "good", "toxic", F.inline(both)).groupBy("part", "good", "toxic", "mask").agg(F.sum("n").alias("n")).where("n > 0")


def interactions(docs: DataFrame, labels: DataFrame, part: str = "lang", **thresholds) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: every step of
    every order of the filters, for each part."""
    masks = range(1 << len(FILTERS))
    counts = [F.coalesce(F.sum(F.when(F.col("mask") == k, F.col("n"))), F.lit(0)) for k in masks]
    marked = lambda c: [F.coalesce(F.sum(F.when((F.col("mask") == k) & F.col(c), F.col("n"))), F.lit(0)) for k in masks]
    wide = failures(docs, labels, part, **thresholds).groupBy("part").agg(F.array(*counts).alias("n"), F.array(*marked("good")).alias("good"), F.array(*marked("toxic")).alias("toxic"))
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = wide.select("*", F.explode(F.array(*map(F.lit, orders))).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    letter, before = F.substring("filter_order", F.col("step"), F.lit(1)), F.substring("filter_order", F.lit(1), F.col("step") - 1)
    has = lambda s: sum((F.when(F.contains(s, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumns({"own": has(letter), "gone": has(before)})
    index = F.sequence(F.lit(0), F.lit(len(masks) - 1))

    def total(column: str, keep, times=lambda k: F.lit(1)) -> Column:
        """The sum of a column's counts over the masks that keep() holds for."""
        return F.aggregate(index, F.lit(0).cast("long"), lambda a, k: a + F.when(keep(k), F.get(F.col(column), k) * times(k)).otherwise(0)).cast("long")

    own, gone = F.col("own"), F.col("gone")
    fails, late = (lambda k: k.bitwiseAND(own) != 0), (lambda k: k.bitwiseAND(gone) != 0)
    removed = lambda k: fails(k) & ~late(k)
    share = lambda k: (F.lit(len(orders)) / F.bit_count(k)).cast("long")  # noqa: E731  of the orders, those in which it comes first
    return steps.select(
        "part", "filter_order", "step", total("n", lambda k: k.bitwiseAND(own.bitwiseOR(gone)) == 0).alias("kept"), total("n", removed).alias("removed"), total("n", lambda k: fails(k) & late(k)).alias("redundant"),
        total("n", lambda k: k == own).alias("unique_fails"), total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), total("n", fails, share).alias("shapley"),
    )
