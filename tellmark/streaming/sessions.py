"""Streaming forms of the run operators over an events stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, by: list[str], at: str, gap: str, late: str) -> DataFrame:
    """Runs of events without a pause of ``gap``: start, end and events; a run is given out once ``late`` has passed over it.

    Works on streams and on tables; state is one open run per key and is dropped with the watermark.
    """
    return (
        events.withWatermark(at, late)
        .groupBy(*by, F.session_window(at, gap).alias("w"))
        .agg(F.count("*").alias("events"))
        .select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
    )


def windowed_counts(events: DataFrame, by: list[str], at: str, width: str, step: str, late: str) -> DataFrame:
    """Events per key in sliding windows, with a watermark for late ones."""
    return (
        events.withWatermark(at, late)
        .groupBy(*by, F.window(at, width, step).alias("w"))
        .agg(F.count("*").alias("events"))
        .select(*by, F.col("w.start").alias("start"), "events")
    )
