"""Streaming forms: tables of tracks and emitters that grow as events arrive (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frame_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Points and their mean position for each window of event time; late rows are waited for."""
    w = F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x")).select(
        F.col("window.start").alias("start"), "n", "x"
    )


def on_times(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "emitter_id") -> DataFrame:
    """Runs of an emitter without a longer dark time than ``gap``: session windows."""
    s = F.session_window("ts", gap)
    g = events.withWatermark("ts", late).groupBy(key, s).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"))
    return g.select(key, F.col("session_window.start").alias("first"), F.col("session_window.end").alias("closed"), "n", "x")


def running_histogram(events: DataFrame, feature: str, lo: float, step: float) -> DataFrame:
    """Counts of fixed bins, updated with each batch."""
    return events.groupBy(F.floor((F.col(feature) - F.lit(lo)) / F.lit(step)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
