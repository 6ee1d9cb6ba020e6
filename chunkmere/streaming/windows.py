"""Windowed aggregates that run alike on tables and on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    """On a stream with a watermark, which wants a time with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, length: str, every: str | None = None, late: str = "1 hour") -> DataFrame:
    """Per event type and window: ``start, n, cents``; on a stream events may be ``late``."""
    cents = F.round(F.col("value") * 100).cast("long")
    held = _timed(events, late)
    w = F.window("ts", length, every) if every else F.window("ts", length)
    return held.groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n"), F.sum(cents).alias("cents")).select("event_type", F.col("w.start").alias("start"), "n", "cents")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Per user: runs of events with less than ``gap`` between them."""
    held = _timed(events, late)
    return held.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def without_repeats(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once; on a stream repeats are known within the watermark."""
    return _timed(events, late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
