"""Spark session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that change results or that every plan relies on.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session with the engine's defaults; keyword settings use ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName("corpusloom")
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false"}
    conf |= {k.replace("__", "."): v for k, v in extra.items()}
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
