"""Exactly-once ingest of a stream into a table of the latest rows by key.

A batch writes what it changes to a folder of its own number, then a row to the log. Readers only see
folders that the log names. A batch that died before its log row is done again into the same folder; one
that comes again after it does nothing. Reads take the latest row of each key over all batches, and
compaction writes these to a new base that later reads begin with.
"""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.corpus import changed
from corpusloom.sources.storage import stored


@dataclasses.dataclass(frozen=True)
class Table:
    """Rows by ``key``; rows whose ``hash`` column stays as it is are not written again; of a batch's rows of one key that with the largest ``order`` counts."""

    spark: SparkSession
    root: str
    key: str
    hash: str
    order: str

    def log(self) -> list:
        """(batch, folder, base) in order of batches, from the newest base on."""
        rows = stored(self.spark, f"{self.root}/log")
        if rows is None:
            return []
        found = rows.orderBy("batch", "base").collect()  # a row a batch since the newest compaction, and the older ones' numbers
        last = max((i for i, r in enumerate(found) if r.base), default=0)
        return found[last:]

    def done(self, batch: int) -> bool:
        rows = stored(self.spark, f"{self.root}/log")
        return rows is not None and not rows.where(F.col("batch") >= batch).isEmpty()

    def read(self) -> DataFrame | None:
        """The latest row of each key; None before the first batch."""
        parts = self.log()
        if not parts:
            return None
        every = None
        for r in parts:
            part = self.spark.read.parquet(f"{self.root}/{r.folder}").withColumn("_batch", F.lit(r.batch).cast("long") * 2 - int(r.base))
            every = part if every is None else every.unionByName(part)
        names = [c for c in every.columns if c != "_batch"]
        if len(parts) == 1:
            return every.select(*names)
        latest = every.groupBy(F.col(self.key).alias("_key")).agg(F.max_by(F.struct(*names), "_batch").alias("r"))
        return latest.select(*[F.col("r")[c].alias(c) for c in names])

    def apply(self, rows: DataFrame, batch: int) -> None:
        """For ``foreachBatch``."""
        if self.done(batch):
            return
        new = rows.groupBy(F.col(self.key).alias("_key")).agg(F.max_by(F.struct(*rows.columns), F.struct(self.order, self.hash)).alias("r")).select(*[F.col("r")[c].alias(c) for c in rows.columns])
        old = self.read()
        fresh = new if old is None else changed(new, old.select(self.key, self.hash), self.key, self.hash)
        fresh.write.mode("overwrite").parquet(f"{self.root}/batch-{batch}")
        self._logged(batch, f"batch-{batch}", False)

    def compact(self) -> None:
        """Writes the latest rows as a base; batches up to it need not be read again."""
        parts = self.log()
        if len(parts) > 1:
            folder = f"base-{uuid.uuid4().hex}"
            self.read().write.parquet(f"{self.root}/{folder}")
            self._logged(parts[-1].batch, folder, True)

    def _logged(self, batch: int, folder: str, base: bool) -> None:
        row = self.spark.range(1).select(F.lit(batch).cast("long").alias("batch"), F.lit(folder).alias("folder"), F.lit(base).alias("base"))
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/log")


def run(new: DataFrame, table: Table, checkpoint: str):
    """All that is there now, batch by batch, then stops."""
    return new.writeStream.foreachBatch(table.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
