"""Live forms: traces cut from an event stream by inactivity, and running call counts. Beyond what the batch operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_sessions(log: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n_events, n_errors of each stretch of activity. Events later than the watermark are dropped."""
    rows = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    sessions = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"), F.sum((F.col("event_type") == "error").cast("long")).alias("n_errors"))
    return sessions.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "n_errors")


def live_call_counts(log: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, event_type, n, value in windows of fixed length."""
    rows = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n", "value")
