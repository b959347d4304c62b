"""The event operators on streams: ids once within the watermark, weekly counts as windows close."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "1 day") -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def weekly_counts(stream: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Event counts by type and seven-day window starting on Mondays (UTC)."""
    dated = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return dated.groupBy(F.window(ts, "7 days", startTime="4 days").alias("w"), "event_type").agg(F.count("*").alias("events")).select(F.col("w.start").cast("date").alias("week"), "event_type", "events")
