"""Entries with a time to live: looked up in a stream with state and timers, or in a table with a window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What both forms take and give.
ENTRIES = "key string, ts timestamp, id long, stores boolean, value string"
READS = "key string, ts timestamp, id long, hit boolean, value string"


class TimeToLive(StatefulProcessor):
    """One entry a key. A store replaces it and ends ``ttl`` milliseconds later; a read that comes then or after drops it, and so does a timer once the watermark has passed, so state of keys that nobody reads goes too."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "value string, ends long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "id"])
        value, ends = self.entry.get() if self.entry.exists() else (None, None)
        before, out = ends, []
        for ts, ident, stores, new in zip(frame["ts"], frame["id"], frame["stores"], frame["value"]):
            now = ts.value // 1_000_000
            if ends is not None and now >= ends:
                value, ends = None, None
            if stores:
                value, ends = new, now + self.ttl
            else:
                out.append((key[0], ts, ident, ends is not None, value))
        if ends is None:
            self.entry.clear()
        else:
            self.entry.update((value, ends))
        if before is not None and before != ends:
            self.handle.deleteTimer(before)
        if ends is not None and before != ends:
            self.handle.registerTimer(ends)
        yield pd.DataFrame(out, columns=["key", "ts", "id", "hit", "value"]).astype({"key": "object", "id": "int64", "hit": "bool", "value": "object"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists() and self.entry.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        yield pd.DataFrame({"key": pd.Series(dtype="object"), "ts": pd.Series(dtype="datetime64[ns]"), "id": pd.Series(dtype="int64"), "hit": pd.Series(dtype="bool"), "value": pd.Series(dtype="object")})

    def close(self) -> None:
        pass


def reads(entries: DataFrame, ttl_seconds: int, late: str = "10 minutes") -> DataFrame:
    """READS of ENTRIES: each read with the entry that its key has then.

    Of a key, rows count in order of (ts, id). A stream must bring them in that order from one batch to
    the next, but for ``late`` at most; a table gives the same rows.
    """
    if entries.isStreaming:
        keyed = entries.withWatermark("ts", late).groupBy("key")
        return keyed.transformWithStateInPandas(TimeToLive(ttl_seconds * 1000), READS, "Append", "EventTime")
    so_far = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("stores"), F.struct("ts", "value")), ignorenulls=True).over(so_far)
    live = F.col("last").isNotNull() & (F.unix_millis("ts") < F.unix_millis("last.ts") + ttl_seconds * 1000)
    found = entries.withColumn("last", last).where(~F.col("stores"))
    return found.select("key", "ts", "id", F.coalesce(live, F.lit(False)).alias("hit"), F.when(live, F.col("last.value")).alias("value"))


def use_rocksdb(spark) -> None:
    """The state store that processors with timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
