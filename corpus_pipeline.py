"""Five stages over `documents`: each a function of (spark, docs, sf_dir), written as Parquet
and read again as the next one's docs.

1. quality: texts that the line CRF rejects go.
2. near_dedup: one document stays of each group linked by 5-word shingles at 0.8.
3. repeats: strings of 50 bytes that also start in a document with a smaller doc_id are
   removed, in whole characters; a document with nothing left goes.
4. decontaminate: documents that hold a benchmark item go.
5. mix: the target mix is drawn, with mix_domain, mix_tokens and mix_copies.

Defined results.  Null, empty and blank texts are rejected by the first stage; given to
the others alone they are kept but for mix, which draws no text without words.  Rows
without doc_id are judged by their texts, linked with none and have nothing removed.  Very
long texts are read whole by every stage (a task's memory follows the longest one).  Ties
go to the smaller doc_id.  Repeated rows of one doc_id and text are copies, of which
near_dedup leaves one.  An empty table gives an empty one.  Other columns of documents,
whatever their names, pass through all stages (mix_domain, mix_tokens and mix_copies give
way in the last).  What a stage stores on its way is dropped once its result is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestream.llm import decontam, mixing, neardup, quality, suffixdedup
from lodestream.llm.common import Stored, read, scratch
from lodestream.llm.queries import MIX, mix_domain


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.reject_bad(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs, k=5, percent=80)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixdedup.drop_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mix_domain(), **MIX)


STAGES = [("quality", keep_good), ("near_dedup", near_dedup), ("repeats", remove_repeats), ("decontaminate", decontaminate), ("mix", mix_sources)]

#: The classifier, the similarity groups and the byte ranges have no SQL form; tests hold each stage over odd rows, and its operator against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch() as made:
            now = Stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        for t in [*made, *([last] if last is not None else [])]:
            if t is not now:
                t.drop()
        docs, last = now.df, now
    return docs
