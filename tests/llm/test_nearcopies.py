"""The pipeline's near-copy stage against brute force over five-word shingles."""

import random

import corpus_pipeline
from corpusloom.llm import nearcopies, simhash

DOCS = "doc_id long, text string, lang string"


def grams(text):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def near(x, y):
    return x == y or 10 * len(x & y) >= 8 * len(x | y) > 0


def brute(rows):
    """The smallest doc_id of each set of near copies."""
    sets, up = {d: grams(t) for d, t, _ in rows}, {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a in sets:
        for b in sets:
            if a < b and near(sets[a], sets[b]):
                low, high = sorted((find(a), find(b)))
                up[high] = low
    return {find(d) for d in sets}


def corpus():
    rng = random.Random(12)
    rows = []
    for k in range(40):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(8, 220))]
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 3000)}"
            rows.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    rows += [None, "", " \n", "one", "One", "two words", "a b c d", "a b c d e"]
    rng.shuffle(rows)
    return [(i, t, "en") for i, t in enumerate(rows)]


def test_stage_keeps_one_of_each_set_of_near_copies(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    got = corpus_pipeline.keep_one_of_each(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(brute(rows))
    assert corpus_pipeline.keep_one_of_each(spark, docs.limit(0), "").count() == 0


def test_copies_of_more_than_two_bits_go(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(base), "en")] + [(k, " ".join(base[: 20 * k] + ["new"] + base[20 * k + 1 :]), "en") for k in (2, 3)]
    docs = spark.createDataFrame(rows, DOCS)
    assert simhash.near_duplicates(docs).select("component_id").distinct().count() == 3
    assert [r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()] == [1]


def test_repeated_ids_and_rows_without_one(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(7, long, "en"), (7, long, "en"), (7, "another text of seven short words here", "en"), (3, long + " tail", "en"), (None, long, "en")]
    got = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, [(3, long + " tail"), (7, rows[2][1]), (None, long)]))


def test_bands_meet_at_the_threshold():
    rng = random.Random(3)
    missed = 0
    for _ in range(2000):
        both = [rng.getrandbits(64) for _ in range(80)]
        a, b = (nearcopies.np.unique(nearcopies.np.array(both + [rng.getrandbits(64) for _ in range(10)], nearcopies.np.uint64)) for _ in range(2))
        missed += not (nearcopies.band_keys(a) == nearcopies.band_keys(b)).any()
    assert missed == 0


def test_pages_of_one_template_are_not_compared_in_all_pairs(spark, monkeypatch):
    """Pages of 200 shared and 40 own words, and a near copy of every hundredth."""
    counted = []
    plain = nearcopies.verified
    monkeypatch.setattr(nearcopies, "verified", lambda pairs, *rest: counted.append(pairs.count()) or plain(pairs, *rest))
    shared = " ".join(f"t{i}" for i in range(200))
    pages = 1500
    rows = [(k, f"{shared} " + " ".join(f"p{k}w{i}" for i in range(40)), "en") for k in range(pages)]
    rows += [(pages + k, rows[k][1].replace(f"p{k}w39", "new"), "en") for k in range(0, pages, 100)]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()) == list(range(pages))
    assert sum(counted) < 64 * len(rows) and counted[-1] <= len(rows)


def test_crowds_lose_no_pair(spark, monkeypatch):
    """Every key is a crowd; shares from none to all, around the threshold."""
    monkeypatch.setattr(nearcopies, "FEW", 1)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(160):
        cut = rng.randint(80, 120)
        rows.append((k, " ".join(base[:cut] + [f"o{k % 40}x{i}" for i in range(rng.randint(0, 30))]), "en"))
    docs = spark.createDataFrame(rows, DOCS)
    got = corpus_pipeline.keep_one_of_each(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(brute(rows))
    sets = {k: grams(t) for k, t, _ in rows}
    packed = [(k, nearcopies.shingles(t.encode()).tobytes()) for k, t, _ in rows]
    members = spark.createDataFrame([(k, len(sets[k]), k) for k in sets], "fp long, n long, label long")
    pairs = nearcopies.crowded(members, spark.createDataFrame(packed, "fp long, s binary"))
    found = {(r.a, r.b) for r in pairs.collect()}
    want = {(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b])}
    assert want and want <= found
