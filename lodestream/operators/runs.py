"""Saved runs: which may be shown, the latest complete one of each article at a time, and how it stands to a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts of a run's name that mark it as superseded
STALE_MARKERS = ("_rules_complete", "_rules_final", "_debug", "_probe", "_dedup_fix")
# end of the fixed values


def shown(name: Column, always: tuple[str, ...] = (), hidden_prefix: str | None = None) -> Column:
    """Whether a run of this name is shown: those in `always` are; others not if they carry a stale marker or, with
    `hidden_prefix`, begin with it. Case doesn't matter; a null name is not shown."""
    low = F.lower(name)
    out = F.lit(True)
    for marker in STALE_MARKERS:
        out = out & ~low.contains(marker)
    if hidden_prefix is not None:
        out = out & ~low.startswith(hidden_prefix.lower())
    return F.coalesce(low.isin(*[a.lower() for a in always]) | out, F.lit(False))


def latest(asked: DataFrame, runs: DataFrame, by: str = "article_id") -> DataFrame:
    """Each row of `asked` (`by`, once each, and asked_at) with `run`: a struct of the latest complete run of the article
    at or before that time, null if there is none; ties go to the greater run_name.
    runs: `by`, run_at, run_name, complete and any further columns.

    As each article is asked once, the join makes at most a row a run, and the maximum is taken before rows are
    exchanged as well as after: an article with any share of all runs costs a row a task. Null articles have no runs."""
    r = runs.where("complete").select(F.col(by).alias("of_article"), "run_at", F.struct("run_at", "run_name", *[c for c in runs.columns if c not in ("run_at", "run_name", "complete", by)]).alias("candidate"))
    j = asked.select(F.col(by).alias("asked_article"), "asked_at").join(r, (F.col("asked_article") == F.col("of_article")) & (F.col("run_at") <= F.col("asked_at")))
    best = j.groupBy("asked_article").agg(F.max_by("candidate", F.struct("candidate.run_at", "candidate.run_name")).alias("run"))
    return asked.join(best, asked[by] == best["asked_article"], "left").drop("asked_article")


def against(score: Column, baseline: float) -> Column:
    """struct<improvement, multiplier, reached>: difference to the baseline, ratio (0 without a baseline), and whether it is met."""
    return F.struct((score - baseline).alias("improvement"), (score / baseline if baseline else score * 0).alias("multiplier"), (score >= baseline).alias("reached"))
