"""The manifest against a plain build of the trees."""

import hashlib
import random
import zlib

import pytest

from corpusloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx int, part string"
H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(row, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def build(level):
    """Levels from the leaves to the root, and the run of each node."""
    levels = [level]
    while len(levels[-1]) > 1:
        level = levels[-1]
        levels.append([H(*level[i : i + 3]) for i in range(0, len(level), 3)])
    return levels


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    own = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        own[s] = build([leaf(r, r[1]) for r in groups[s]])
    top = build([own[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            text = r[1].replace("\n", "") if r[1] is not None and zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0 else r[1]
            again, proof = leaf(r, text), []
            for levels, at in ((own[s], i), (top, k)):
                for level in levels[:-1]:
                    run = level[at - at % 3 : at - at % 3 + 3]
                    proof += run[: at % 3] + run[at % 3 + 1 :]
                    run[at % 3] = again
                    again, at = H(*run), at // 3
            out.append((r[0], leaf(r, r[1]), own[s][-1][0], top[-1][0], H(*proof), again, again == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("size,sources,parts", [(0, 3, 4), (1, 1, 4), (3, 3, 4), (40, 40, 4), (300, 4, 4), (400, 1, 30), (500, 7, 40)])
def test_manifest(spark, size, sources, parts):
    rng = random.Random(size)
    name = lambda: rng.choice([None, "", *(f"s{k}é" for k in range(sources - 1)), "s0é", "s0é"]) if sources > 1 else "one"
    if sources == 40:  # hardly any group has two leaves
        name = iter([f"s{k}" for k in range(39)] + [None]).__next__
    rows = [(rng.choice([None, k, k, k, 7]), rng.choice([None, "", "a\nb", "\n", "plain", "long\n" * 5000]), rng.choice([None, "en"]), name(), rng.choice([None, 5]), 1, "clash") for k in range(size)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), fan=5 if parts > 4 else 64)
        got = sorted(map(tuple, got.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == expected(rows)
    assert not size or parts == 4 or any(r[6] for r in got) and not all(r[6] for r in got)


def test_frontier_is_small(spark):
    """A part of any stretch of leaves leaves a few nodes a level behind."""
    rows = spark.range(2000).selectExpr("0 as part", "0L as g", "0 as level", "id + 700 as idx", "100000L as size", "sha2(string(id), 256) as digest")
    left = merkle.frontier(rows.coalesce(1), 1).collect()
    assert 0 < len(left) <= 4 * 11 and all(r.level < 7 for r in left)
