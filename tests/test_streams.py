"""Streams against the same plans over tables, with batches that die and come again."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import sinks
from corpusloom.streaming import incremental, state

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def entries(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    return e.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("id"), (F.col("event_id") % 3 == 0).alias("stores"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("value"))


def test_time_to_live(spark, tmp_path):
    state.use_rocksdb(spark)
    table = entries(spark)
    cuts = table.approxQuantile("seconds", [0.3, 0.6], 0) if "seconds" in table.columns else table.selectExpr("percentile(unix_seconds(ts), array(0.3, 0.6)) as p").first().p
    low = F.unix_seconds("ts")
    for name, part in (("a", low < cuts[0]), ("b", (low >= cuts[0]) & (low < cuts[1])), ("c", low >= cuts[1])):
        table.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spread = table.selectExpr("max(unix_seconds(ts)) - min(unix_seconds(ts)) as s").first().s
    ttl = max(60, int(spread // 50))
    stream = spark.readStream.schema(state.ENTRIES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = state.reads(stream, ttl, late="1 second").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination()
    rows = lambda d: sorted((r.key, r.ts, r.id, r.hit, r.value) for r in d.collect())
    want = rows(state.reads(table, ttl))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == want
    assert {r[3] for r in want} == {True, False}
    # timers leave no state of keys that are over
    held = [p["numRowsTotal"] for p in run.recentProgress[-1]["stateOperators"]]
    assert sum(held) < table.select("key").distinct().count() * 2


def docs(spark, low, high, mark):
    return spark.range(low, high).selectExpr("id as k", f"concat('{mark}', cast(id as string)) as text", "id % 5 as at").withColumn("h", F.sha2("text", 256))


@pytest.fixture
def table(spark, tmp_path):
    return incremental.Table(spark, str(tmp_path / "table"), "k", "h", "at")


def content(t):
    return {r.k: r.text for r in t.read().collect()}


def test_incremental(spark, tmp_path, table):
    schema = "k long, text string, at long, h string"
    feed = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    docs(spark, 0, 50, "a").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert table.read() is None
    incremental.run(feed(), table, str(tmp_path / "cp")).awaitTermination()
    assert content(table) == {k: f"a{k}" for k in range(50)}

    class Dies(incremental.Table):
        def _logged(self, batch, folder, base):
            raise RuntimeError("killed before the log row")

    docs(spark, 40, 60, "b").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="killed"):
        incremental.run(feed(), Dies(spark, table.root, "k", "h", "at"), str(tmp_path / "cp")).awaitTermination()
    assert content(table) == {k: f"a{k}" for k in range(50)}
    incremental.run(feed(), table, str(tmp_path / "cp")).awaitTermination()
    want = {k: f"a{k}" if k < 40 else f"b{k}" for k in range(60)}
    assert content(table) == want and [r.batch for r in table.log()] == [0, 1]
    # a batch that comes again, even with other rows, writes nothing
    table.apply(docs(spark, 0, 5, "c"), 1)
    assert content(table) == want
    # rows that did not change are not written
    table.apply(docs(spark, 38, 42, "a").unionByName(docs(spark, 58, 60, "b")), 2)
    assert {r.k for r in spark.read.parquet(f"{table.root}/batch-2").collect()} == {40, 41}
    want |= {40: "a40", 41: "a41"}
    assert content(table) == want
    table.compact()
    assert content(table) == want and len(table.log()) == 1
    table.apply(docs(spark, 0, 1, "z").unionByName(docs(spark, 0, 1, "y").withColumn("at", F.lit(9).cast("long"))), 3)
    assert content(table) == want | {0: "y0"} and [r.base for r in table.log()] == [True, False]


def test_published_lines(spark, tmp_path):
    root, schema = str(tmp_path / "p"), "k long, text string"
    assert sinks.published_jsonl(spark, root, schema) is None
    sinks.publish_jsonl(docs(spark, 0, 3, "a").select("k", "text"), root, "k")
    before = sinks.published_jsonl(spark, root, schema)
    sinks.ordered_jsonl(docs(spark, 0, 9, "x").select("k", "text"), f"{root}/version-died", "k")
    assert [r.text for r in sinks.published_jsonl(spark, root, schema).orderBy("k").collect()] == ["a0", "a1", "a2"]
    sinks.publish_jsonl(docs(spark, 0, 2, "b").select("k", "text"), root, "k")
    assert [r.text for r in sinks.published_jsonl(spark, root, schema).orderBy("k").collect()] == ["b0", "b1"] and before.count() == 3
    lines = [line for f in sorted((tmp_path / "p").glob("version-*/part-*")) for line in f.read_text().splitlines()]
    assert '{"k":0,"text":"a0"}' in lines
