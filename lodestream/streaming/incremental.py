"""New documents as they arrive: the extraction is row-local up to the suppression of prose on
table pages, so it runs as a stream of micro-batches, each document with its own pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestream.operators import evidence, normalize, rules, validate
from lodestream.spec import ASSAYS, DomainSpec


def records(parsed: DataFrame, spec: DomainSpec = ASSAYS) -> DataFrame:
    """Checked records of a batch of parsed documents."""
    return validate.checked(normalize.record(rules.extract(evidence.chunks(parsed, spec), spec)))


def run(parsed_stream: DataFrame, out: str, checkpoint: str, spec: DomainSpec = ASSAYS, transform: Callable[[DataFrame, DomainSpec], DataFrame] = records) -> StreamingQuery:
    """Appends each batch's records to `out`; a batch that is run again after a failure overwrites its own part."""

    def each(batch: DataFrame, n: int) -> None:
        transform(batch, spec).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return parsed_stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
