"""Table access, scratch tables and size hints shared by the operators."""

from __future__ import annotations

import atexit
import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder (tests, a laptop).
LOCAL_SCRATCH = "/tmp/checkpoints/lodestream"

#: Words are runs of anything but blank and U+0009..U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z alone, whatever the locale."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(c: Column, m: int) -> Column:
    return F.crc32(c.cast("string").cast("binary")) % m


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local one only where none is set."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = LOCAL_SCRATCH
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/lodestream-{sc.applicationId}"


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_roots: set[str] = set()


def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        for root in _roots:
            drop_path(spark, root)


atexit.register(_sweep)


_open: list[list[Stored]] = []


@contextmanager
def scratch() -> Iterator[list[Stored]]:
    """The tables stored while it is open, which may be dropped as soon as what was made of them is written."""
    made: list[Stored] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open[:] = [m for m in _open if m is not made]


class Stored:
    """A DataFrame written to the shared folder and read back: its lineage is cut,
    and the loss of any executor leaves it readable.  drop() frees the disk."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        root = scratch_root(self.spark)
        _roots.add(root)
        self.path = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
        for made in _open:
            made.append(self)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def store(df: DataFrame, name: str) -> DataFrame:
    return Stored(df, name).df


def size_hint(df: DataFrame, column: str = "text") -> int:
    """Catalyst's estimate of the bytes read; where it has none (it then gives a huge number), half the bytes of a column.
    It sets how finely work is divided, never what is computed."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if n < 1 << 50:
        return n
    return int((df.agg(F.sum(F.octet_length(column))).first()[0] or 0) // 2)


def pieces(df: DataFrame, bytes_each: int, least: int = 4) -> int:
    """Number of buckets that keeps each near bytes_each of the (compressed) input."""
    return max(least, math.ceil(size_hint(df) / bytes_each))


def require(df: DataFrame, *names: str) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing column(s) {missing}; there are {df.columns}")
