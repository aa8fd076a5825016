"""Structured Streaming forms of the windowed operators; the reference semantics are batch, these are additions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Count and sum per type and tumbling window; rows later than ``late`` are left out."""
    timely = events.withWatermark("ts", late)
    return timely.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    timely = events.withWatermark("ts", late)
    return timely.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def without_repeats(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
