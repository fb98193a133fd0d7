"""Exact duplicates against a loop."""

import hashlib
import random

import pytest

from corpusloom.llm import dedup

SCHEMA = "doc_id long, text string, keep_id string, part int"


def expected(rows):
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r"), []).append((-len(t or ""), d is None, d or 0, i))
    out = []
    for bare, members in groups.items():
        first = min(members)
        for m in members:
            out.append((rows[m[3]][0], rows[first[3]][0], len(members), m[3] == first[3], hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits,size", [(None, 0), (3, 400), (6, 400)])
def test_groups(spark, monkeypatch, bits, size):
    rng = random.Random(size)
    rows = [(rng.choice([None, *range(300)]), rng.choice([None, "", " \n", "a b", "ab", "a  b", "ab ", "é" * 3, "x" * 20_000, " x" * 20_000, f"one {rng.randint(0, 99)}", f"one{rng.randint(0, 99)} \r"])) for _ in range(size)]
    if bits:  # more partitions than rows need: further rounds
        monkeypatch.setattr(dedup, "ROUND_BITS", 2)
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(1 << bits))
    try:
        table = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA).repartition(5)
        got = sorted(map(tuple, dedup.exact_duplicates(table).collect()), key=str)
    finally:
        if bits:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    want = expected(rows)
    # rows that repeat a group's first one in all but their place may stay in its stead
    assert got == want


def test_digests_are_verified(spark):
    """Entries whose digests agree but not their second hashes stay apart."""
    entry = lambda second, doc: (0, 0, b"\0" * 32, second, 1, doc, doc, 1)
    runs = spark.createDataFrame([entry(1, 5), entry(2, 6), entry(1, 4)], dedup.ENTRY)
    assert sorted((r.second, r.doc_id, r.members) for r in dedup.merged(runs, 1).collect()) == [(1, 4, 2), (2, 6, 1)]


def test_no_task_gets_a_large_group(spark):
    """A group of all rows reaches each partition of the first round once from each scan task."""
    table = spark.range(5000).selectExpr("id as doc_id", "'same text' as text").repartition(8)
    runs = dedup.first_runs(dedup.digests(table), 3).collect()
    assert len(runs) <= 8 and sum(r.members for r in runs) == 5000
