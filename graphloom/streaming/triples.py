"""Triples from a stream of events: ingestion with a watermark, and counts of edges by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """Event files of a folder as they come."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def edges(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """id, src, dst, type, ts of events: a user did a thing; events without user or kind are left out, repeated ids within the watermark are one.

    Works on streams and on tables.
    """
    kept = events.where(F.col("user_id").isNotNull() & F.col("event_type").isNotNull() & F.col("event_id").isNotNull())
    once = kept.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else kept.dropDuplicates(["event_id"])
    return once.select(F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("id"), F.concat(F.lit("customer:"), F.col("user_id").cast("string")).alias("src"), F.concat(F.lit("key:"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("none"))).alias("dst"), F.upper("event_type").alias("type"), "ts")


def windowed(found: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, type, n: edges of each kind by window of time; in a stream, windows are given when the watermark passes them."""
    rows = found.withWatermark("ts", late) if found.isStreaming else found
    return rows.groupBy(F.window("ts", width).alias("w"), "type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "type", "n")
