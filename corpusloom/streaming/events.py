"""Structured Streaming over append-only logs; every plan also runs on a batch table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, folder: str, schema: str, format_: str = "json", files: int = 64) -> DataFrame:
    """A log folder as a stream; a bounded number of files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(format_).load(folder)


def rates(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes", label: str = "event_type") -> DataFrame:
    """Counts per window and label; on a stream, rows later than ``late`` behind the newest are left out."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", width).alias("w"), label).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), label, "n")


def percentiles(events: DataFrame, value: str, width: str = "5 minutes", late: str = "10 minutes", share: float = 0.95) -> DataFrame:
    """Approximate percentile per window, mergeable across tasks."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", width).alias("w")).agg(F.percentile_approx(value, share, 10_000).alias("p"))
    return out.select(F.col("w.start").alias("window_start"), "p")


def fresh(entries: DataFrame, keys: list[str], ttl: str = "1 day") -> DataFrame:
    """First entry of each key within the time to live; state older than that goes."""
    return entries.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def incremental(new: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``apply`` on each batch of what is new, all that is there now, then stops."""
    return new.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
