"""Telemetry as streams: the same reports as over tables, kept up to date as events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def frequent(events: DataFrame) -> DataFrame:
    """Counts and means of category/name pairs; for output mode complete or update."""
    return events.groupBy(F.concat_ws("/", "category", "name").alias("what")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by category in tumbling windows of event time; events later than the watermark are left out."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", size), "category").agg(F.count(F.lit(1)).alias("n"))
    return by.select(F.col("window.start").alias("start"), "category", "n")


def quiet(events: DataFrame, period: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Bursts of a key that end after a quiet period: its first and last event and their number."""
    by = events.withWatermark("ts", late).groupBy(F.session_window("ts", period), "name").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return by.select("name", F.col("session_window.start").alias("first"), "last", "n")


def insert_once(events: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def keep_ring(stream: DataFrame, path: str, checkpoint: str, size: int = 1000) -> StreamingQuery:
    """Keeps the latest ``size`` events of a stream as a table: each micro-batch is merged into the ring and swapped in."""
    from granary.operators.integrity import ring_buffer
    from granary.sources.files import exists
    from granary.sources.sinks import replace

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(path) if exists(spark, path) else batch.limit(0)
        replace(ring_buffer(old.unionByName(batch).dropDuplicates(["id"]), size), path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()
