"""Session helpers: the shared folder, written intermediate tables, skew."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where the session names none and runs in one process (tests, local runs) a temporary folder is
    made and set as the checkpoint folder; on a cluster the executors wouldn't share it, so there it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        sc = spark.sparkContext
        kept = sc._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            return kept.get()
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="basalt-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read again.

    Cuts lineage and survives lost executors; what reads it twice computes once. The table is deleted when the application ends.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)


#: Whether Spark removes the shuffle files of a query when the query ends.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the DataFrames made within go as soon as their query ends, else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_TIDY)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)


#: At most this many keys count as hot, so what is broadcast for them is bounded by it.
HOT_KEYS = 256


def hot_keys(df: DataFrame, key: str, at_least: int = 10_000) -> list:
    """Keys of more than 1/HOT_KEYS of the rows, and of at_least rows: by counting, fewer than HOT_KEYS exist."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    large = counts.filter((F.col("n") >= at_least) & F.col(key).isNotNull()).orderBy(F.desc("n")).limit(HOT_KEYS + 1)
    total = df.agg(F.count(F.lit(1)).alias("all"))
    rows = large.join(F.broadcast(total), F.col("n") * HOT_KEYS > F.col("all")).collect()
    return [r[0] for r in rows]


def join_with_hot_keys(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: list | None = None, also: list[str] | None = None) -> DataFrame:
    """left join right on key and the columns also (inner or left), where few keys may hold most of left.

    right has few rows per key. Rows of hot keys of left meet a broadcast of right's rows of
    those keys (fewer than HOT_KEYS of them); all others meet in a shuffle join, which then
    has no key of more than 1/HOT_KEYS of the rows. Loops that join one left side often count its hot keys once.
    """
    hot = hot_keys(left, key) if hot is None else hot
    on = [key, *(also or [])]
    if not hot:
        return left.join(right, on, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = left.filter(~is_hot).join(right.filter(~is_hot), on, how)
    return cold.unionByName(left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), on, how))
