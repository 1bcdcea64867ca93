"""Event-time counters: the same plan over a stream or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counters(events: DataFrame, width: str = "1 hour", *, lateness: str = "10 minutes") -> DataFrame:
    """``start, calls, errors, error_rate`` of each window; late events within ``lateness`` count in streams."""
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    return (
        rows.groupBy(F.window("ts", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("calls"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("errors"))
        .select(F.col("w.start").alias("start"), "calls", "errors", F.round(F.col("errors") / F.col("calls"), 6).alias("error_rate"))
    )


def user_sessions(events: DataFrame, gap: str = "30 minutes", *, lateness: str = "10 minutes") -> DataFrame:
    """``user_id, start, n`` of each run of events with gaps below ``gap``."""
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
