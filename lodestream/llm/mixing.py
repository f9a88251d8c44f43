"""Operator 8: mixing to target weights by hierarchical budgeting, in SQL functions alone.

The token budget flows down a tree of domain, language and source.  At each node it is
shared among the children by weight; a child never gets more than its subtree holds
(its tokens times max_epochs), and what it can't use goes to its siblings by weight.
Only what all siblings together can't use is left to the parent, whose capacity was
the sum of theirs, so shortages meet siblings before they meet ancestors' siblings.

A leaf's budget is whole epochs and a rest.  Each epoch is a seeded permutation (by md5
of seed, epoch and doc_id); the rest is that epoch's longest prefix within it.  The
prefix is found without sorting the leaf: tokens are summed per slot of the leading
SLOT_DIGITS hash digits, and only the one slot that straddles the cut is ordered by row.
Texts are read for their tokens once: where these aren't given, the rows are written with
them, and sums and slots then read a few short columns.

Defined results: null domains, languages and sources are nodes named `unknown`;
weights that aren't given are the default, negative ones count as 0; of docs' columns
mix_domain, mix_tokens and mix_copies alone give way to those added here, other names
that begin with `mix_` stay; texts without words (null, empty) are never selected, very
long ones count whole; an empty table gives no rows; repeated rows count as rows; rows
of one hash (null or repeated ids) come in the order of doc_id and tokens."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.llm.common import WORD, Stored, require

SLOT_DIGITS = 3
#: Leaves up to this many are broadcast (some 10 MB); more are joined over salted keys.
MAX_BROADCAST_LEAVES = 50_000
SALTS = 64
_LEVELS = ("mix_domain", "mix_lang", "mix_source")


def _weight(name: Column, given: Mapping[str, float], default: float) -> Column:
    w = F.lit(float(default))
    if given:
        table = F.create_map(*[F.lit(x) for k, v in sorted(given.items()) for x in (k, float(v))])
        w = F.coalesce(F.try_element_at(table, name), w)
    return F.greatest(w, F.lit(0.0))


def _share(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """Adds `got`: the part of `budget` that each child of `parents` gets; needs w, cap, budget.

    Children in order of cap/w fill up first; the level at which the rest share by
    weight follows from sums over those before and after, with no iteration."""
    by = Window.partitionBy(*parents)
    order = by.orderBy(F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf"))), *[c for c in _LEVELS if c in nodes.columns])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = nodes.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.nullif(F.sum("w").over(after), F.lit(0.0)))
    t = t.withColumn("full", (F.col("w") > 0) & (F.col("level") * F.col("w") >= F.col("cap")))
    # where someone isn't full, all beyond share at that one's level
    cut = F.min(F.when(~F.col("full") & (F.col("w") > 0), F.struct(F.col("cap") / F.col("w"), *[F.col(c) for c in _LEVELS if c in nodes.columns], F.col("level").alias("level")))).over(by)
    return t.withColumn("got", F.when(F.col("full"), F.col("cap")).when(F.col("w") > 0, F.floor(cut["level"] * F.col("w"))).otherwise(F.lit(0)).cast("long")).drop("level", "full")


def _hash(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def token_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(
    docs: DataFrame,
    domain: Column,
    domain_weights: Mapping[str, float],
    lang_weights: Mapping[str, float],
    source_weights: Mapping[str, float],
    fraction: float = 1.0,
    max_epochs: int = 2,
    seed: int = 17,
    default_weight: float = 1.0,
    tokens: Column | None = None,
) -> DataFrame:
    """The selected rows with all columns of docs, and mix_domain, mix_tokens and mix_copies
    (how often the row is drawn).  The budget is `fraction` of all tokens there are.
    tokens: those of a row, where docs has them (it is read several times); else words of `text`."""
    require(docs, "doc_id", "lang", "source", *(["text"] if tokens is None else []))
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("mix_domain", "mix_tokens", "mix_copies")])
    plain = docs.columns
    own = {c: f"own_{i}_{c}" for i, c in enumerate(plain) if c.lower().startswith("mix_")}
    named = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    added = {"mix_domain": named(domain), "mix_lang": named(F.col("lang")), "mix_source": named(F.col("source")), "mix_tokens": token_count("text") if tokens is None else F.coalesce(tokens, F.lit(0)).cast("long")}
    rows = docs.select(*[F.col(f"`{c}`").alias(own.get(c, c)) for c in plain], *[v.alias(k) for k, v in added.items()])
    if tokens is None:
        rows = Stored(rows, "mix-rows").df
    leaves = Stored(rows.groupBy(*_LEVELS).agg(F.sum("mix_tokens").alias("tokens")), "mix-leaves")

    leaf = leaves.df.withColumn("cap", F.col("tokens") * max_epochs)
    budget = leaf.agg(F.floor(F.sum("tokens") * F.lit(float(fraction))).cast("long")).first()[0] or 0
    top = leaf.groupBy("mix_domain").agg(F.sum("cap").alias("cap")).withColumn("w", _weight(F.col("mix_domain"), domain_weights, default_weight)).withColumns({"root": F.lit(0), "budget": F.lit(budget).cast("long")})
    top = _share(top, ["root"]).select("mix_domain", F.col("got").alias("budget"))
    mid = leaf.groupBy("mix_domain", "mix_lang").agg(F.sum("cap").alias("cap")).withColumn("w", _weight(F.col("mix_lang"), lang_weights, default_weight)).join(top, "mix_domain")
    mid = _share(mid, ["mix_domain"]).select("mix_domain", "mix_lang", F.col("got").alias("budget"))
    low = leaf.withColumn("w", _weight(F.col("mix_source"), source_weights, default_weight)).join(mid, ["mix_domain", "mix_lang"])
    low = _share(low, ["mix_domain", "mix_lang"])
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("got") / F.col("tokens"))).otherwise(F.lit(0)).cast("long")
    plan = Stored(low.select(*_LEVELS, epochs.alias("mix_epochs"), (F.col("got") - epochs * F.col("tokens")).alias("mix_rest")), "mix-plan")
    n_leaves = plan.df.count()

    def with_plan(left: DataFrame, right: DataFrame) -> DataFrame:
        if n_leaves <= MAX_BROADCAST_LEAVES:
            return left.join(F.broadcast(right), list(_LEVELS))
        salted = right.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return left.withColumn("mix_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [*_LEVELS, "mix_salt"]).drop("mix_salt")

    drawn = lambda p: (
        with_plan(rows, p).where("mix_tokens > 0").withColumn("mix_hash", _hash(seed, F.col("mix_epochs") + 1)).withColumn("mix_slot", F.substring("mix_hash", 1, SLOT_DIGITS))
    )
    slots = drawn(plan.df.where("mix_rest > 0")).groupBy(*_LEVELS, "mix_slot").agg(F.sum("mix_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*_LEVELS).orderBy("mix_slot"))
    # the first slot whose tokens go beyond the rest, and what lies before it
    cuts = slots.withColumn("upto", upto).join(plan.df, list(_LEVELS)).where(F.col("upto") > F.col("mix_rest"))
    cuts = cuts.groupBy(*_LEVELS).agg(F.min(F.struct("mix_slot", (F.col("upto") - F.col("n")).alias("below"))).alias("cut"))
    full = Stored(plan.df.join(cuts, list(_LEVELS), "left").select(*_LEVELS, "mix_epochs", "mix_rest", F.coalesce("cut.mix_slot", F.lit("")).alias("mix_cut"), F.coalesce("cut.below", F.lit(0)).cast("long").alias("mix_below")), "mix-full")

    all_rows = drawn(full.df)
    easy = all_rows.where("mix_slot <> mix_cut").withColumn("mix_copies", F.col("mix_epochs") + F.when(F.col("mix_slot") < F.col("mix_cut"), 1).otherwise(0))
    run = F.sum("mix_tokens").over(Window.partitionBy(*_LEVELS, "mix_slot").orderBy("mix_hash", "doc_id", "mix_tokens").rowsBetween(Window.unboundedPreceding, 0))
    edge = all_rows.where("mix_slot = mix_cut").withColumn("mix_run", F.col("mix_below") + run)
    edge = edge.withColumn("mix_copies", F.col("mix_epochs") + F.when(F.col("mix_run") <= F.col("mix_rest"), 1).otherwise(0)).drop("mix_run")
    for s in (leaves, plan):
        s.drop()
    return easy.unionByName(edge).where("mix_copies > 0").select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in plain], "mix_domain", "mix_tokens", "mix_copies")
