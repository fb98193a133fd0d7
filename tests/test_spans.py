"""Entities with places against a loop over the same patterns."""

import os
import random
import re

from pyspark.sql import functions as F

from corpusloom.functions import spans
from corpusloom.plans import registry
from corpusloom.plans.texts import ENTITY_KINDS
from corpusloom.streaming import sketches

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def expected(text, kinds):
    taken = []
    for kind, pattern in kinds:
        for m in re.finditer(pattern, text or "", re.ASCII):
            if not any(a < m.end() and m.start() < b for a, b, *_ in taken):
                taken.append((m.start(), m.end(), kind, m.group()))
    return sorted(taken)


def test_random_texts(spark):
    rng = random.Random(5)
    kinds = [("ab", "ab+"), ("word", "[a-c]+"), ("end", "é$"), ("two", "..é")]
    rows = [(k, "".join(rng.choice("abc é😀-") for _ in range(rng.randint(0, 30)))) for k in range(300)] + [(300, None), (301, ""), (302, "ab" * 2000)]
    got = spark.createDataFrame(rows, "k long, t string").select("k", spans.entities(F.col("t"), kinds).alias("s")).collect()
    assert {r.k: [tuple(x) for x in r.s] for r in got} == {k: expected(t, kinds) for k, t in rows}


def test_documents(spark):
    got = {}
    for r in registry.queries()["cls_entity_spans"](spark, SF).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.kind, r.value))
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {r.doc_id: expected(r.text, ENTITY_KINDS) for r in rows}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v} and len(got) > 10


def test_sketches_merge(spark):
    rows = spark.range(20_000).selectExpr("timestamp_seconds(id * 7) as ts", "'x' as label", "case when id % 50 = 0 then null else double(pmod(hash(id), 1000)) end as v")
    short = sketches.windows(rows, "v", "10 minutes", "label")
    day = {r.window_start: r for r in sketches.longer(short, "1 day", "label").select("window_start", "n", sketches.quantile(0.5).alias("m")).collect()}
    for r in rows.groupBy(F.window("ts", "1 day")["start"].alias("w")).agg(F.sort_array(F.collect_list("v")).alias("vs")).collect():
        values, m = r.vs, day[r.w].m
        assert day[r.w].n == len(values)
        assert sum(v < m for v in values) <= (0.5 + sketches.ERROR) * len(values) + 1 and sum(v <= m for v in values) >= (0.5 - sketches.ERROR) * len(values) - 1
