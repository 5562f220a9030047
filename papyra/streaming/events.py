"""Windowed counts that serve batch tables and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watermarked(events: DataFrame, late: str) -> DataFrame:
    """A stream with a watermark on ts, which must be a timestamp with a zone for that."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    if events.isStreaming:
        events = watermarked(events, late)
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events with less than gap between neighbours."""
    if events.isStreaming:
        events = watermarked(events, late)
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, key: list[str], late: str = "10 minutes") -> DataFrame:
    """One event for each key; in a stream, within the time that late ones are waited for."""
    if events.isStreaming:
        return watermarked(events, late).dropDuplicatesWithinWatermark(key)
    return events.dropDuplicates(key)
