"""Streaming forms of the batch operators: calendar counts, sessions and deduplication.

The batch operators have no streams; these are natural extensions of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, files_each: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def _watched(events: DataFrame, late: str | None) -> DataFrame:
    """With a watermark; None: a step before has set it."""
    return events.withWatermark("ts", late) if late else events


def tumbling_counts(events: DataFrame, every: str = "1 day", late: str | None = "1 hour") -> DataFrame:
    """Counts and sums by calendar window and type; rows later than the watermark are left out once a window is closed."""
    w = F.window("ts", every)
    return _watched(events, late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("begin"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, length: str = "2 hours", slide: str = "1 hour", late: str | None = "1 hour") -> DataFrame:
    return _watched(events, late).groupBy(F.window("ts", length, slide)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("begin"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    s = F.session_window("ts", gap)
    return _watched(events, late).groupBy(s, "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "n")


def first_events(events: DataFrame, late: str | None = "1 hour") -> DataFrame:
    """Of rows with the same event_id one."""
    return _watched(events, late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
