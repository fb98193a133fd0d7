"""Operators on small tables with answers by hand."""

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import url as U
from corpusloom.operators import corpus as C
from corpusloom.operators import ranking as R
from corpusloom.sources import readers, sinks


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return frame.select(column.alias("x")).first().x


def test_fusion_prefers_rows_of_both_channels(spark):
    rows = [("q", c, i + 1) for channel in (["a", "b", "c"], ["b", "a", "d"]) for i, c in enumerate(channel)]
    fused = R.rrf(spark.createDataFrame(rows, "q string, id string, rank int"), "q", "id").orderBy(F.desc("score"), "id").collect()
    assert {r.id for r in fused[:2]} == {"a", "b"}


def test_metrics(spark):
    rows = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 0), (2, 1, 0)], "q int, rank int, label int")
    got = {r.q: r for r in R.metrics(rows, "q").collect()}
    assert (got[1].hit, got[1].mrr, got[1].top1, got[1].top3) == (1, 0.5, 0, 1)
    assert (got[2].hit, got[2].mrr, got[2].ndcg) == (0, 0.0, 0.0)


def test_min_max_of_equal_scores_is_one(spark):
    rows = spark.createDataFrame([("q", 2.0), ("q", 2.0), ("p", 1.0), ("p", 3.0)], "q string, s double")
    got = sorted(rows.select("q", R.min_max(F.col("s"), "q").alias("x")).collect())
    assert [round(r.x, 3) for r in got] == [0.05, 1.0, 1.0, 1.0]


def test_urls(spark):
    assert one(spark, U.canonicalize(F.col("u")), u="HTTP://Ex.Com//a//b%20c?q=1#/EN/x") == "http://ex.com/a/b c?q=1#/EN/x"
    assert one(spark, U.unquote(F.col("u")), u="a+b%2") == "a+b%2"
    assert one(spark, U.route_slug(F.col("u")), u="https://a.example/#/EN/Home/Page?x=1") == "Home/Page"


def test_base64_noise_goes_and_words_stay(spark):
    assert one(spark, T.strip_base64(F.col("t")), t="before " + "QUJDRA12" * 20 + " after") == "before after"


def test_markdown_pads_and_escapes(spark):
    rows = F.array(F.array(F.lit("Question"), F.lit("Answer")), F.array(F.lit("a|b")))
    assert one(spark, T.table_markdown(rows)) == "| Question | Answer |\n| --- | --- |\n| a\\|b |  |"


def test_stems(spark):
    assert [one(spark, T.stem_en(F.lit(w))) for w in ("policies", "classes", "rates", "bus", "cards")] == ["policy", "class", "rate", "bus", "card"]


def test_jaccard_of_wordless_texts_is_zero(spark):
    a, b = T.shingles(F.lit("?!")), T.shingles(F.lit("one two three four"))
    assert one(spark, T.jaccard(a, b)) == 0.0
    assert one(spark, T.jaccard(b, b)) == 1.0


def test_chunks_number_parents_and_children_together(spark):
    docs = spark.createDataFrame([(1, "intro\n## A\nfirst\n\nsecond\n[TABLE]\nx | y\n[/TABLE]")], "id int, text string")
    got = C.chunks(docs, "id", F.col("text")).orderBy("chunk_index").collect()
    assert [r.level for r in got] == ["parent", "child", "parent", "child", "child", "child"]
    assert got[3].text.startswith("## A\n[TABLE]") and got[3].parent_index == 2
    assert [r.chunk_index for r in got] == list(range(6))
    assert C.indexable(C.chunks(docs, "id", F.col("text")), "id").count() == 4


def test_snapshot_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("gone", "1")], "k string, h string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "k string, h string")
    assert sorted(r.k for r in C.changed(new, old, "k", "h").collect()) == ["b", "c"]
    assert [r.k for r in C.stale(old, new, "k").collect()] == ["gone"]


def test_upsert_snapshot_round_trip(spark, tmp_path):
    old = spark.createDataFrame([("a", "1", "x"), ("gone", "1", "y")], "k string, h string, t string")
    new = spark.createDataFrame([("a", "2", "z"), ("b", "1", "w")], "k string, h string, t string")
    written, skipped = sinks.upsert(new, old, "k", "h", str(tmp_path / "snap"))
    assert (written, skipped) == (2, 0)
    assert sorted(r.t for r in spark.read.parquet(str(tmp_path / "snap")).collect()) == ["w", "y", "z"]


def test_jsonl_reader_skips_marked_and_short_rows(spark, tmp_path):
    lines = ['{"id": "1", "url": "u", "content": "%s", "metadata": {"duplicate_of": null}}' % ("word " * 40), '{"id": "2", "url": "u", "content": "short", "metadata": {}}', "", '{"id": "3", "url": "u", "content": "%s", "metadata": {"duplicate_of": "1"}}' % ("word " * 40)]
    (tmp_path / "d.jsonl").write_text("\n".join(lines))
    assert [r.id for r in readers.jsonl(spark, str(tmp_path / "d.jsonl")).collect()] == ["1"]


def test_zip_reader_reports_failures(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("x/EN/pages/a/data.json", '{"url": "https://a.example"}')
        z.writestr("x/AR/pages/b/data.json", "{bad")
        z.writestr("x/EN/pages/c/other.txt", "t")
    good, bad = readers.zip_pages(spark, str(tmp_path / "s.zip"))
    assert [(r.folder, r.language) for r in good.collect()] == [("x/EN/pages/a", "en")]
    assert sorted(r.folder for r in bad.collect()) == ["x/AR/pages/b", "x/EN/pages/c"]


def test_curated_documents_must_be_valid(spark):
    rows = spark.createDataFrame([("1", "approved", "2030-01-01"), ("2", "approved", "2020-01-01"), ("3", "retired", "2030-01-01")], "id string, status string, valid_until string")
    assert [r.id for r in readers.valid(rows, "2025-01-01").collect()] == ["1"]


def test_stream_counts_like_the_batch(spark, tmp_path):
    from corpusloom.streaming import events as E

    rows = spark.range(200).select(F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id * 7)").alias("ts"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("event_type"))
    rows.write.json(str(tmp_path / "log"))
    stream = E.rates(E.read_log(spark, str(tmp_path / "log"), "ts timestamp, event_type string"))
    q = stream.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, E.rates(rows).collect()))


def test_compression_drops_near_copies(spark):
    import corpusloom.operators.procedural as P

    text = "the quick brown fox jumps over the lazy dog near the old river bank today"
    rows = [(1, "quick fox", 1, "a", "u1", "", text), (1, "quick fox", 2, "b", "u2", "", text + " ok"), (1, "quick fox", 3, "c", "u3", "", "something else about a quick answer to another question entirely")]
    got = P.compress(spark.createDataFrame(rows, "query_id int, query string, pos int, chunk_id string, url string, heading string, text string"))
    assert sorted(r.chunk_id for r in got.collect()) == ["a", "c"]


def plain_compress(rows, budget, alike):
    """The greedy context of one query (pos, chunk_id, url, heading, text) over texts that share a query word, in a plain loop."""
    grams = lambda t: {tuple(w[i : i + 3]) for w in [t[:400].lower().split()] for i in range(max(1, len(w) - 2))}
    out, used = {}, 0
    for pos, chunk, url, heading, text in sorted(rows):
        if len(text) < 20:
            continue
        own = grams(text)
        if any(len(own & grams(t)) / len(own | grams(t)) >= alike for _, _, t in out.values()):
            continue
        place, cost = (url or chunk, heading[:40]), max(1, len(text) // 4)
        if place in out:
            old = out[place][2]
            new = old if text in old else old + "\n" + text
            more = max(1, len(new) // 4) - max(1, len(old) // 4)
            if used + more <= budget:
                out[place], used = (*out[place][:2], new), used + more
        elif out and used + cost > budget:
            break
        else:
            out[place], used = (pos, chunk, text), used + cost
    return sorted(out.values())


def test_compression_is_the_greedy_choice(spark):
    from corpusloom.operators import procedural as P

    rng = __import__("random").Random(6)
    word = lambda: "w" + str(rng.randint(0, 30))
    rows = []
    for q in range(12):
        texts: list[str] = []
        for pos in range(10):
            text = rng.choice(texts) + " tail" if texts and rng.random() < 0.25 else " ".join(["key", *[word() for _ in range(rng.randint(0, 40))]])
            texts.append(text)
            rows.append((q, "the key", pos, f"c{pos}", rng.choice(["", "u1", "u2", "u3"]), rng.choice(["", "h"]), text))
    frame = spark.createDataFrame(rows, "query_id int, query string, pos int, chunk_id string, url string, heading string, text string")
    got: dict = {}
    for r in P.compress(frame, budget=120).collect():
        got.setdefault(r.query_id, []).append((r.pos, r.chunk_id, r.text))
    for q in range(12):
        assert sorted(got[q]) == plain_compress([r[2:] for r in rows if r[0] == q], 120, 0.82)


def test_difflib_compares_only_what_may_reach_the_least(spark, monkeypatch):
    import difflib

    import corpusloom.operators.procedural as P

    rows = [(0, "same text" * 30, "same text" * 30), (1, "abcdefgh" * 20, "abcdefgi" * 20), (2, "aaaa" * 20, "zzzz" * 20), (3, "short", "a much longer text than that"), (4, None, "x"), (5, "", "")]
    frame = spark.createDataFrame(rows, "k int, x string, y string").repartition(4, "k")
    whole = {r.k: r.s for r in frame.select("k", P.difflib_ratio(F.col("x"), F.col("y")).alias("s")).collect()}
    assert whole == {k: difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for k, x, y in rows}
    scored = frame.select("k", P.difflib_ratio(F.col("x"), F.col("y"), least=0.8).alias("s")).where("s >= 0.8")
    assert {r.k: r.s for r in scored.collect()} == {k: s for k, s in whole.items() if s >= 0.8}
    # the ratio is taken after the pairs are dealt, and once
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("RepartitionByExpression")


def test_difflib_compares_whole_texts(spark):
    import difflib

    import corpusloom.operators.procedural as P

    rng = __import__("random").Random(4)
    # the first 12,000 characters are the same, what follows is not
    head = "".join(rng.choice("abcdefgh ") for _ in range(12_000))
    one, two = head + "x" * 4_000, head + "y" * 4_000
    got = spark.createDataFrame([(one, two)], "x string, y string").select(P.difflib_ratio(F.col("x"), F.col("y")).alias("s")).first().s
    assert got == difflib.SequenceMatcher(None, one, two).ratio() < 0.9


def test_near_duplicates_move_the_hashes_of_candidates_only(spark, monkeypatch):
    rng = __import__("random").Random(8)
    text = lambda: [f"w{rng.randrange(500)}" for _ in range(60)]
    rows = []
    for i in range(40):
        words = text()
        rows.append((2 * i, rng.choice("xy"), " ".join(words)))
        if i % 2:
            words[rng.randrange(60)] = "other"
        # a near copy or a copy, of another group at times, at times of none
        rows.append((2 * i + 1, rng.choice(["x", "y", None]) if i % 4 else rows[-1][1], " ".join(words if i % 3 else text())))
    docs = spark.createDataFrame(rows, "k long, g string, t string")
    grams = lambda t: {tuple(w[j : j + 5]) for w in [t.split()] for j in range(len(w) - 4)}
    want = set()
    for a, g, t in rows:
        for b, h, u in rows:
            both = len(grams(t) & grams(u)) / len(grams(t) | grams(u))
            if a < b and g is not None and g == h and both >= 0.5:
                want.add((a, b, round(both, 6)))
    found = lambda: C.near_duplicates(docs, "k", "g", F.col("t"), threshold=0.5)
    shown = lambda frame: {(r.a, r.b, round(r.similarity, 6)) for r in frame.collect()}
    frame = found()
    assert shown(frame) == want and any(s < 1 for *_, s in want) and any(s == 1 for *_, s in want)
    # copies and texts without a candidate leave before anything is moved: the wanted keys come to them
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "strategy=broadcast" in plan and "LeftAnti" not in plan
    monkeypatch.setattr(C, "SENT", 0)
    assert shown(found()) == want


def test_near_difflib_is_the_ratio_of_its_candidates(spark, tmp_path):
    import difflib

    from corpusloom.plans.corpus import dup_near_difflib

    rng = __import__("random").Random(9)
    rows = []
    for i in range(12):
        words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
        for j, own in enumerate((words, words, [*words[:-1], "other"], words + words[: 4 * i])):
            rows.append((4 * i + j, "x", " ".join(own)))
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.a, r.b): r.similarity for r in dup_near_difflib(spark, str(tmp_path)).collect()}
    pairs = C.near_duplicates(spark.createDataFrame(rows, "doc_id long, lang string, text string"), "doc_id", "lang", F.col("text"), threshold=0.5)
    ratio = lambda a, b: round(difflib.SequenceMatcher(None, rows[a][2], rows[b][2]).ratio(), 4)
    every = {(r.a, r.b): ratio(r.a, r.b) for r in pairs.collect()}
    assert got == {k: s for k, s in every.items() if s >= 0.9} and len(got) < len(every) and 1.0 in got.values() and min(got.values()) < 1
