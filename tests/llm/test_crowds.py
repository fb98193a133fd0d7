"""Crowded keys of the near-copy stage: only pairs whose bitmaps allow the threshold are compared."""

import random

from corpusloom.llm import nearcopies


def test_pairs_that_share_rare_shingles_but_too_few_of_all_are_not_compared(spark):
    rng = random.Random(9)
    many, own = 80, {}
    for k in range(many):
        # the neighbour's rarest shingles, and half of all the others' common ones
        rare = [1_000_000 * (k // 2) + i for i in range(30)]
        own[k] = set(rare) | set(rng.sample(range(7_000_000_000, 7_000_000_140), 100))
    for k in range(0, many, 8):  # and some real pairs
        own[k + 1] = set(own[k]) - {max(own[k])}
    mixed = {k: {x * 0x9E3779B97F4A7C15 % (1 << 64) for x in s} for k, s in own.items()}
    packed = [(k, nearcopies.np.array(sorted(s), nearcopies.np.uint64).tobytes()) for k, s in mixed.items()]
    members = spark.createDataFrame([(k, len(s), k) for k, s in mixed.items()], "fp long, n long, label long")
    found = {(r.a, r.b) for r in nearcopies.crowded(members, spark.createDataFrame(packed, "fp long, s binary")).collect()}
    alike = lambda a, b: len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])
    want = {(a, b) for a in own for b in own if a < b and alike(a, b)}
    assert len(want) >= many // 8 and want <= found
    assert len(found) <= len(want) + 3
