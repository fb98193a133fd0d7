"""Collocations against plain counts, with small thresholds."""

import collections
import random
import re

import numpy as np
import pytest

from corpusloom.llm import collocations as C

SCHEMA = "doc_id long, lang string, text string, phrase string, n int"


def expected(rows, least, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang or "und"] += len(words)
            for i in range(len(words)):
                for k in range(1, 6):
                    if i + k <= len(words):
                        f[lang or "und", tuple(words[i : i + k])] += 1
    frequent = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    out = collections.defaultdict(list)
    for (lang, w), a in frequent.items():
        if any(x[0] == lang and len(x[1]) > len(w) and b >= a and any(x[1][i : i + len(w)] == w for i in range(len(x[1]) - len(w) + 1)) for x, b in frequent.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


@pytest.mark.parametrize("shard", [C.SHARD, 7])
def test_phrases(spark, shard, monkeypatch):
    monkeypatch.setattr(C, "FLUSH", 64)
    monkeypatch.setattr(C, "CHUNK", 50)
    rng = random.Random(3)
    vocabulary = ["the", "of", "Of", "a", "é", "ÉA", "x\x00", "x", "new", "york", "\x1c", "a b", "-", "los", "angeles", "w" * 200]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ; ", "\x0b", "?!"]
    text = lambda n: "".join(rng.choice([rng.choice(vocabulary) + rng.choice(ends), "new york city" + rng.choice(ends), "the of the of "]) for _ in range(n))
    rows = [(rng.choice([None, "und", "en", "de"]), rng.choice([None, "", " . ", text(5), text(40), text(60)])) for _ in range(120)] + [("en", text(3000))] + [("fr", "only once said here")] * 3
    table = spark.createDataFrame([(1, lang, t, "clash", 2) for lang, t in rows], SCHEMA).repartition(5)
    got = sorted(map(tuple, C.collocations(table, least=12, top=40, shard=shard).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    assert got == expected(rows, 12, 40) and len(got) > 80


def test_empty(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.collocations(spark.createDataFrame([(1, None, None, "", 1)], SCHEMA)).count() == 0


def test_words_do_not_depend_on_chunks(monkeypatch):
    text = b"one two  three\xff four \xff\xfffive six " * 40 + b"x" * 500
    whole = C.Words(text, 5)
    monkeypatch.setattr(C, "CHUNK", 7)
    parts = C.Words(text, 5)
    assert [text[i:j] for i, j in zip(whole.begin, whole.end)] == text.replace(b"\xff", b" ").split()
    assert np.array_equal(whole.hash, parts.hash) and np.array_equal(whole.begin, parts.begin) and np.array_equal(whole.piece, parts.piece)
    assert len(set(whole.hash.tolist())) == len(set(text.replace(b"\xff", b" ").split()))


def test_bounds_are_upper_bounds(spark):
    """With a sketch far too small every phrase passes, and the results are still exact."""
    rows = [(1, "en", " ".join(f"w{k % 97} v{k % 89}" for k in range(3000)), "", 1)]
    texts = C.texts_of(spark.createDataFrame(rows, SCHEMA))
    bits = C.sketch(texts, C.FEWEST, 5, 5)
    words = C.Words(bytes(texts.first().text), C._salt("en"))
    n, at, hashes = next(iter(words.grams(2)))
    unique, count = np.unique(hashes, return_counts=True)
    assert bits.passes(unique[count >= 5]).all() and not bits.passes(unique[count < 5]).all()


def test_one_pass_whatever_the_number_of_candidates(spark):
    """Candidates beyond a shard must not cost another scan of the texts."""
    rows = [(1, "en", " ".join(f"w{k % 50} v{k % 50}" for k in range(600)), "", 1)] * 3
    table = spark.createDataFrame(rows, SCHEMA)
    spark.range(1).count()

    def jobs(shard):
        spark.sparkContext.setJobGroup(f"shard-{shard}", "")
        found = C.collocations(table, least=12, top=40, shard=shard).collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"shard-{shard}")), found

    (one, found), (many, same) = jobs(C.SHARD), jobs(7)
    assert one == many and found == same and len(found) > 7


def test_phrases_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(C, "_mixed", lambda x: x & np.uint64(1))
    bits = C.Bits(C.FEWEST, {k: b"\xff" * (C.BLOCK // 8) for k in range(2)})
    n, counts = C.tally(b"a b c a b\xffa b", "en", bits, bits, 3)
    assert n == 7 and counts == {b"a": 3, b"b": 3, b"c": 1, b"a b": 3, b"b c": 1, b"c a": 1, b"a b c": 1, b"b c a": 1, b"c a b": 1}
