"""Request metrics and drift over streams: an extension, with watermarks for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need timestamps of a time zone: those without are taken as the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def event_rates(events: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total of a stream of events (ts, event_type, value); state ends once a window is late."""
    out = _timed(events).withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, session_start, session_end, n: runs of a user's events without a gap."""
    out = _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def value_drift(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, n, mean, least, most of value, to be held against a baseline."""
    out = _timed(events).withWatermark("ts", late).groupBy(F.window("ts", every).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    return out.select(F.col("w.start").alias("window_start"), "n", "mean", "least", "most")
