"""Events as streams: sessions by a gap, and repeated deliveries dropped. Beyond what a single-process memory needs; batch and stream agree."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def sessionised(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """user_id, started_at, ended_at, events: runs of a user's events without a gap. A stream needs the watermark; a batch ignores it."""
    x = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        x = x.withWatermark("at", late)
    g = x.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.max("at").alias("ended_at"))
    return g.select("user_id", F.col("w.start").alias("started_at"), "ended_at", "events")


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that the stream's source holds now, processed once and written to a table in the shared folder."""
    spark: SparkSession = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def distinct_events(events: DataFrame, key: str, late: str = "2 days") -> DataFrame:
    """Events without repeated deliveries of one key."""
    x = events.withColumn("at", F.col("ts").cast("timestamp"))
    return x.withWatermark("at", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else x.dropDuplicates([key])
