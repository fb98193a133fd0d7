"""Quantiles of windows from KLL sketches: kept for short windows, merged into longer ones, never over rows again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of a sketch, and the rank error that it keeps with 99 % confidence.
K, ERROR = 200, 0.0165


def windows(events: DataFrame, value: str, width: str, label: str, late: str = "10 minutes", k: int = K) -> DataFrame:
    """(window_start, label, n, sketch) of a stream or a table with ``ts``; values that are null count for nothing."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", width).alias("w"), label).agg(F.count(value).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))
    return out.select(F.col("w.start").alias("window_start"), label, "n", "sketch")


def longer(sketches: DataFrame, width: str, label: str) -> DataFrame:
    """The same for windows that hold several of the given ones."""
    out = sketches.groupBy(F.window("window_start", width).alias("w"), label).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return out.select(F.col("w.start").alias("window_start"), label, "n", "sketch")


def quantile(share: float):
    """The value at a rank, from the column ``sketch``."""
    return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(share)))
