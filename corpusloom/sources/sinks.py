"""Sinks: snapshots, ordered lines and logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.corpus import changed
from corpusloom.sources.storage import stored


def upsert(new: DataFrame, old: DataFrame, key: str, hash_: str, path: str) -> tuple[int, int]:
    """Writes a snapshot of ``old`` with changed and new rows of ``new`` in it; returns (written, skipped)."""
    fresh = changed(new, old, key, hash_)
    kept = old.join(fresh.select(key), key, "left_anti")
    kept.unionByName(fresh).write.mode("overwrite").parquet(path)
    written = fresh.count()
    return written, new.count() - written


def prune(stored: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Stored rows whose key is still there."""
    return stored.join(ids.select(key), key, "left_semi")


def ordered_jsonl(rows: DataFrame, path: str, *order: str) -> None:
    """Sorted lines with fields in alphabetical order, so reruns write the same bytes; a global sort keeps files in order."""
    rows.select(*sorted(rows.columns)).orderBy(*order).write.mode("overwrite").json(path)


def publish_jsonl(rows: DataFrame, root: str, *order: str) -> None:
    """``ordered_jsonl`` as a new version below ``root``; readers find it once its log row is written, and the version before until then."""
    folder = f"version-{uuid.uuid4().hex}"
    ordered_jsonl(rows, f"{root}/{folder}", *order)
    row = rows.sparkSession.range(1).select(F.lit(folder).alias("folder"), F.current_timestamp().alias("at"))
    row.coalesce(1).write.mode("append").parquet(f"{root}/log")


def published_jsonl(spark: SparkSession, root: str, schema: str) -> DataFrame | None:
    """The newest whole version below ``root``; None where there is none."""
    log = stored(spark, f"{root}/log")
    newest = log and log.orderBy(F.desc("at"), "folder").first()
    return newest and spark.read.schema(schema).json(f"{root}/{newest.folder}")


def append_events(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def audit(rows: DataFrame, query: str = "query") -> DataFrame:
    """Audit rows carry a hash of the query instead of its text."""
    return rows.withColumn("query_hash", F.substring(F.sha2(F.trim(F.col(query)), 256), 1, 16)).drop(query)
