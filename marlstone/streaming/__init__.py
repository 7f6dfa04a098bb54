"""Streaming forms of the plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and value totals of an `events` stream by event type and window.

    `ts` may be a timestamp without zone, which a watermark rejects: it is read in the session's zone.
    Rows later than `late` are dropped by the watermark.
    """
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", width), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    )
