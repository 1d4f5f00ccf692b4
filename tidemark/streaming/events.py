"""Windowed aggregates over an event stream, and the same as a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import table


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and value per window and type; on a stream, windows close ``late`` after their end."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    found = events.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("v"))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.col("v").cast("double").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: first event, number of events; a session ends after a pause of ``gap``."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    found = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """A table's files as a stream."""
    batch = table(spark, folder, name)
    return spark.readStream.schema(batch.schema).parquet(folder + f"/{name}.parquet*")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"events_tumbling_day": lambda s, d: tumbling(table(s, d, "events")), "events_sessions": lambda s, d: sessions(table(s, d, "events"), "6 hours")}


def oracle_sql() -> dict[str, str]:
    return {
        "events_tumbling_day": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2",
        "events_sessions": "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 6 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) a) b GROUP BY user_id, g",
    }
