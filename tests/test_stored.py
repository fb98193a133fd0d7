"""Stored indexes and vectors against plain loops."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import inverted, lexical, prefixes, sparse, vectors
from corpusloom.plans import retrieval
from corpusloom.sources.storage import fresh_path, stored

WORDS = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    pick = lambda n: " ".join(WORDS[min(int(rng.expovariate(0.03)), 199)] for _ in range(n))
    rows = [(k, pick(rng.choice([1, 5, 30, 120])), "en" if k % 3 else "de") for k in range(300)] + [(300, None, "en"), (301, "", "en"), (302, "123", "en"), (303, "wab " * 500, "en")]
    queries = [(k, pick(4)) for k in range(12)] + [(12, "nothing known"), (13, None), (14, WORDS[0] + " " + WORDS[0])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5), spark.createDataFrame(queries, "item_id long, text string"), rows, queries


def plain(rows):
    return sorted((r[0], r[1], round(r[2], 6)) for r in rows)


def test_search_is_bm25(spark, corpus):
    docs, queries, *_ = corpus
    root = fresh_path(spark, "t")
    index = inverted.build(docs, root, "c", carry=("lang",), buckets=8)
    want = plain(lexical.bm25(queries, docs).collect())
    assert plain(inverted.search(index, queries).collect()) == want and len(want) > 1000
    german = {r.doc_id for r in docs.where("lang = 'de'").collect()}
    assert plain(inverted.search(index, queries, only="lang = 'de'").collect()) == [r for r in want if r[1] in german]


@pytest.mark.parametrize(("k", "block"), [(1, 1024), (7, 4), (1000, 5)])
def test_the_best_are_found_where_documents_lie(spark, corpus, k, block):
    docs, queries, rows, _ = corpus
    docs = docs.unionByName(spark.createDataFrame([(1000 + k, rows[3][1], "en") for k in range(50)], docs.schema))  # ties
    index = inverted.build(docs, fresh_path(spark, "t"), "c", carry=("lang",), buckets=8)
    everything = lexical.bm25(queries, docs).withColumn("r6", F.round("score", 6))
    want = lexical.top_k(everything, "item_id", "doc_id", k, "r6")
    got = inverted.top_k(index, queries, k, block=block)
    four = lambda found: sorted((r.item_id, r.doc_id, round(r.score, 6), r.rank) for r in found.collect())
    assert four(got) == four(want) and got.count() > 12
    # neither pairs nor postings are made on the way
    assert stored(spark, f"{index.folder}/postings") is None
    german = lexical.top_k(everything.join(docs.where("lang = 'de'").select("doc_id"), "doc_id"), "item_id", "doc_id", k, "r6")
    assert four(inverted.top_k(index, queries, k, only="lang = 'de'")) == four(german)


def test_an_index_is_only_opened_for_what_it_was_built_from(spark, corpus):
    docs, *_ = corpus
    root = fresh_path(spark, "t")
    version = inverted.corpus_version(docs, "doc_id", "text")
    assert inverted.load(spark, root, "c", version) is None
    built = inverted.build(docs, root, "c", buckets=8)
    assert inverted.load(spark, root, "c", version) == built == inverted.open_or_build(docs.repartition(3), "c", root)
    assert inverted.load(spark, root, "another", version) is None
    other = docs.withColumn("text", F.when(F.col("doc_id") == 7, "new words").otherwise(F.col("text")))
    assert inverted.load(spark, root, "c", inverted.corpus_version(other, "doc_id", "text")) is None
    assert inverted.open_or_build(other, "c", root, buckets=8).folder != built.folder
    # tables without their row, as a build leaves them that died
    dead = fresh_path(spark, "t")
    built.postings().write.partitionBy("bucket").parquet(f"{dead}/index-x/postings")
    assert inverted.load(spark, dead, "c", version) is None


def test_a_search_reads_its_buckets_only(spark, corpus):
    docs, queries, *_ = corpus
    index = inverted.build(docs, fresh_path(spark, "t"), "c", buckets=16)
    plan = inverted.search(index, queries.where("item_id = 14"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan and "PartitionFilters: [bucket" in plan


def test_empty_corpus(spark, corpus):
    docs, queries, *_ = corpus
    index = inverted.build(docs.limit(0), fresh_path(spark, "t"), "c")
    assert inverted.search(index, queries).count() == 0 and index.docs == 0


def cosine_lists(base, asked, k, least=0.0):
    out = []
    for q, v in asked:
        scored = []
        for d, w in base:
            if d != q:
                scored.append((-round(max(0.0, float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))), 6), d))
        out += [(q, d, -s, i) for i, (s, d) in enumerate(sorted(x for x in scored if -x[0] >= least)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [1024, 4])
def test_nearest(spark, block, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS", 50)
    rng = np.random.default_rng(2)
    good = [(k, rng.normal(size=6).round(1).tolist()) for k in range(150)] + [(k, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for k in range(150, 200)]
    bad = [(200, None), (201, [0.0] * 6), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [float("nan")] + [0.0] * 5), (204, [1.0]), (205, [])]
    table = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").repartition(4)
    got = vectors.nearest(table.where("vec_id % 10 = 0"), table, 7, block=block)
    assert sorted((r.query_id, r.vec_id, r.score, r["rank"]) for r in got.collect()) == cosine_lists(good, [x for x in good if x[0] % 10 == 0 and any(x[1])], 7)
    assert vectors.nearest(table.limit(0), table, 3).count() == 0
    other = vectors.nearest(table.where("vec_id < 3").withColumnRenamed("vec_id", "q"), table, 1, qkey="q")
    assert sorted((r.query_id, r.vec_id) for r in other.collect()) == [(0, 0), (1, 1), (2, 2)]


def test_nearest_labels(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=5).tolist(), k % 7) for k in range(90)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {(r.query_id, r.label): r.score for r in vectors.nearest_labels(table.where("vec_id < 20"), table, block=8).collect()}
    for q, v, _ in rows[:20]:
        for label in range(7):
            want = max(max(0.0, float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))) for d, w, n in rows if n == label and d != q)
            assert got[q, label] == pytest.approx(want, abs=1e-6)


def test_only_changed_texts_are_embedded_again(spark):
    seen = spark.sparkContext.accumulator(0)

    def model(lists):
        seen.add(len(lists))
        return vectors.hash_embedding(8)(lists)

    docs = spark.createDataFrame([(k, f"text {'abc'[k % 3]} {WORDS[k]}") for k in range(40)], "doc_id long, text string")
    tokens = T.tokenize(F.col("text"))
    path = fresh_path(spark, "store")
    vectors.refreshed(None, docs, "doc_id", "text", tokens, model).write.parquet(path)
    store, before = spark.read.parquet(path), seen.value
    later = docs.where("doc_id <> 3").withColumn("text", F.when(F.col("doc_id") == 5, "other").otherwise(F.col("text")))
    got = {r.doc_id: r.embedding for r in vectors.refreshed(store, later, "doc_id", "text", tokens, model).collect()}
    assert before == 40 and seen.value == 41 and set(got) == set(range(40)) - {3}
    assert all(got[r[0]] == r[1] for r in vectors.embedded(later, "doc_id", tokens, model).collect())


def test_vectors_of_counted_terms(spark):
    docs = spark.createDataFrame([(1, "two two three"), (2, None), (3, ""), (4, " ".join(f"w{'abc'[k % 3]}" for k in range(500))), (5, "Three é x")], "doc_id long, text string")
    tokens = T.tokenize(F.col("text"))
    want = {r.doc_id: r.embedding for r in vectors.embedded(docs, "doc_id", tokens).collect()}
    rows = docs.select("doc_id", inverted.counts(tokens).alias("c")).coalesce(1)
    assert {r.doc_id: r.embedding for r in vectors.embedded_counts(rows, "doc_id").collect()} == want and sum(want[4]) == 500


def test_documents_of_an_index_are_not_read_again_for_their_vectors(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {'abc'[k % 3]} {WORDS[k]}") for k in range(40)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    retrieval.documents_index(spark, str(tmp_path))
    monkeypatch.setattr(T, "tokenize", None)
    assert retrieval.document_vectors(spark, str(tmp_path)).count() == 40


@pytest.mark.parametrize("most", [0, 20, 1000])
def test_weights_with_few_terms_sent(spark, corpus, most):
    docs, _, rows, _ = corpus
    index = inverted.open_or_build(docs, "few", fresh_path(spark, "t"), buckets=8)
    assert len(sparse.frequent(index, most)[0]) <= most
    df = collections.Counter(t for _, text, _ in rows for t in set(__import__("re").findall("[a-z]{2,}", (text or "").lower())))
    want = {d: [(t, round(x, 5)) for t, x in sorted(weights_of(text, df, len(rows)).items(), key=lambda e: (-round(e[1], 12), e[0]))[:20]] for d, text, _ in rows}
    got = {r.doc_id: [(x.term, x.weight) for x in r.c] for r in sparse.document_weights(index, keep=20, most=most).collect()}
    assert got == {d: w for d, w in want.items() if w}
    # no posting is dealt on the way
    assert stored(spark, f"{index.folder}/postings") is None


def weights_of(text, df, n):
    counts = collections.Counter(w for w in __import__("re").findall("[a-z]{2,}", (text or "").lower()) if w in df)
    w = {t: (1 + math.log(c)) * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t, c in counts.items()}
    norm = math.sqrt(sum(x * x for x in w.values()))
    return {t: x / norm for t, x in w.items()} if norm else {}


@pytest.mark.parametrize("k", [1, 5, 400])
def test_impacts(spark, corpus, k):
    docs, queries, rows, asked = corpus
    index = inverted.open_or_build(docs, "impacts", fresh_path(spark, "t"), buckets=8)
    impacts = sparse.impact_index(index, keep=20)
    df = collections.Counter(t for _, text, _ in rows for t in set(__import__("re").findall("[a-z]{2,}", (text or "").lower())))
    kept = {}
    for d, text, _ in rows:
        w = weights_of(text, df, len(rows))
        kept[d] = {t: round(x, 5) for t, x in sorted(w.items(), key=lambda e: (-e[1], e[0]))[:20]}
    want = []
    for q, text in asked:
        qw = weights_of(text, df, len(rows))
        scored = sorted((-round(s, 6), d) for d, w in kept.items() if (s := sum(x * w.get(t, 0) for t, x in qw.items())) > 0)
        want += [(q, d, i) for i, (_, d) in enumerate(scored[:k], 1)]
    weights = sparse.query_weights(index, queries)
    got = sparse.top_k(impacts, weights, k)
    assert sorted((r.item_id, r.doc_id, r["rank"]) for r in got.collect()) == sorted(want)
    if k == 1:  # the floors leave most of what the queries meet
        met = sum(len([d for d, w in kept.items() if set(w) & set(weights_of(text, df, len(rows)))]) for _, text in asked)
        assert sparse.candidates(impacts, weights, 1).count() < 0.6 * met


def test_prefixes_of_wanted_beginnings(spark):
    rng = random.Random(3)
    titles = [" ".join(rng.choice(["tab", "tall", "ta", "a", "tabular", "be"]) for _ in range(rng.randint(0, 6))) for _ in range(400)] + [" TA  be\t"] * 3
    plain_ = collections.Counter(" ".join(t.split()).lower() for t in titles)
    del plain_[""]
    want = {}
    for t, n in plain_.items():
        words = t.split(" ")
        for p in {" ".join(words[i:])[:k] for i in range(len(words)) for k in range(1, 13)}:
            if not p.endswith(" "):
                want.setdefault(p, []).append((-1.0 if t.startswith(p) else -0.82, -n, t))
    want = {(p, t, -s, -n, k + 1) for p, rows in want.items() for k, (s, n, t) in enumerate(sorted(rows)[:8])}
    frame = spark.createDataFrame([(t,) for t in titles], "first string").repartition(5)
    assert set(map(tuple, prefixes.index(frame, "first").collect())) == want
    asked = spark.createDataFrame([("t",), ("ta",), ("tab be",), ("zz",)], "prefix string")
    assert set(map(tuple, prefixes.index(frame, "first", wanted=asked).collect())) == {x for x in want if x[0] in ("t", "ta", "tab be")}
