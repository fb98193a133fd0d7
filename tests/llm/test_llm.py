"""Training-data operators against brute force, round trips, and tables with nulls, ties, repeats and odd columns."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from corpusloom.llm import ann, decontam, licenses, lm, mixing, pii, simhash, tokens, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, score int"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randint(0, pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls in every column, empty, wordless and very long texts, ties, repeats, near copies; clashing column names."""
    rng = random.Random(4)
    out = [(i, words(rng, rng.randint(1, 60)), "en", f"s{i % 3}", 1, "x", 2) for i in range(60)]
    long = words(rng, 30_000)
    out += [(100, None, None, None, None, None, None), (101, "", "en", "s0", 0, "", 0), (102, " \t\n", "en", None, 3, None, 1), (103, long, "en", "s1", len(long), "", 0), (104, "one", "fr", "s2", 3, "", 0)]
    out += [out[3], out[3], (105, out[5][1], "en", "s0", 1, "", 0), (None, "no id here at all", "en", "s0", 1, "", 0), (106, long + " tail", "de", "s1", 1, "", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1 -----------------------------------------------------------------------------------------------


def vectors(n=700, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[10:14] = x[9]  # ties
    out = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return out + [(9000, None), (9020, [0.0] * dim), (9040, [float("nan")] + [1.0] * (dim - 1)), (9060, [None] + [1.0] * (dim - 1)), (9080, [float("inf")] + [1.0] * (dim - 1)), (None, [1.0] * dim), (9100, [1.0, 2.0])]


def brute_neighbours(data, k):
    use = [(i, np.array(v, np.float64)) for i, v in data if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in use:
        if i % 20 == 0:
            near = sorted(((-float(np.add.accumulate(q * v)[-1]), j) for j, v in use if j != i and len(v) == len(q)))[:k]
            out[i] = [j for _, j in near]
    return out


def test_exact_search_finds_all(spark):
    data = vectors()
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = ann.search(ann.build_index(table, shard_rows=200), table.where("vec_id % 20 = 0"), k=20, factor=1.0).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == {q: v for q, v in brute_neighbours(data, 20).items() if v}


def test_relaxed_pruning_does_less_and_keeps_recall():
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((40, 16)) * 3
    x = (centers[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 16)) * 0.5).astype(np.float64)
    tree = ann.Tree(np.arange(4000), x, float(np.sqrt((x * x).sum(axis=1)).max()))
    q = np.arange(0, 4000, 20)
    exact, who, made = tree.search(q, x[q], 10, 1.0)
    assert made < len(q) * 4000
    _, near, less = tree.search(q, x[q], 10, 1.5)
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(who, near)])
    assert less <= made and recall >= 0.9


def test_ties_everywhere_make_no_deep_tree():
    for rows in (np.eye(3000), np.ones((3000, 4)), np.repeat(np.eye(4), 700, axis=0)):
        n = len(rows)
        tree = ann.Tree(np.arange(n), rows, 1.5)
        score, who, _ = tree.search(np.arange(0, n, 500), rows[::500], 5, 1.0)
        for q, got, near in zip(range(0, n, 500), score, who):
            every = rows @ rows[q]
            want = sorted((i for i in range(n) if i != q), key=lambda i: (-every[i], i))[:5]
            assert list(got) == [every[i] for i in want] and list(near) == want


def test_queries_visit_few_cells_and_keep_recall(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((32, 16)) * 4
    x = centers[rng.integers(0, 32, 4000)] + rng.standard_normal((4000, 16)) * 0.3
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    index = ann.build_index(table, shard_rows=125)
    assert index.shards.count() >= 32
    queries = table.where("vec_id % 20 = 0")
    sim = x @ x.T
    np.fill_diagonal(sim, -9)
    want = {i: set(np.argsort(-sim[i], kind="stable")[:10].tolist()) for i in range(0, 4000, 20)}
    for factor, least in ((1.0, 1.0), (1.5, 0.9)):
        got = {}
        for r in ann.search(index, queries, 10, factor).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert np.mean([len(got[i] & want[i]) / 10 for i in want]) >= least
    # what is sent: the home cell, then the cells that the k-th distance leaves open
    asked = ann.usable(queries).selectExpr("vec_id", "v", "size(v) as dim", "double('-inf') as floor")
    home = ann.visits(index, asked)
    assert home.count() == 200
    kth = ann.nearest(ann.met(index, home, 10, 1.0), 10).where("rank = 10").selectExpr("query_id as vec_id", "score as floor")
    others = ann.visits(index, asked.drop("floor").join(kth, "vec_id"), 1.0).count()
    assert others < 200 * index.shards.count() / 4


def test_search_of_odd_tables(spark):
    kind = "vec_id long, embedding array<double>, rank int, v string"
    none = spark.createDataFrame([], kind)
    some = spark.createDataFrame([(1, [1.0, 0.0], 1, ""), (1, [1.0, 0.0], 1, ""), (2, [0.0, 1.0], 2, None), (20, [1.0, 1.0], 3, "")], kind)
    assert ann.search(ann.build_index(none), some).count() == 0
    assert ann.search(ann.build_index(some), none).count() == 0
    got = ann.search(ann.build_index(some, shard_rows=1), some.where("vec_id = 20"), 5).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 1, 1.0), (2, 1, 1.0), (3, 2, 1.0)]


# 2 -----------------------------------------------------------------------------------------------


def test_licences_and_inheritance(spark):
    files = [("/a/LICENSE", "Released under the MIT License."), ("/a/x/code", "words of prose"), ("/a/x/y/deep", None), ("/b/z", "more"), ("/a/x/own", "code code code\n" + "more code " * 20 + "\nLicensed under the Apache License, Version 2.0."), (None, ""), ("/a/x/own2", "This work is licensed under the GNU General Public License, version 3.")]
    got = {r.path: (r.license, r.origin) for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got["/a/LICENSE"] == ("MIT", "file")
    assert got["/a/x/own"] == ("Apache-2.0", "header")
    assert got["/a/x/y/deep"] == ("GPL-3.0", "inherited")  # /a/x holds a licence file of its own
    assert got["/b/z"] == (None, "none")
    assert got[None] == (None, "none")


def test_licences_of_no_files(spark):
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_wrapped_headers_and_whole_licence_texts(spark):
    text = dict(licenses.TEXTS)
    wrap = lambda t, n, mark="": "\n".join(mark + " ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    header = "This program is free software: you can redistribute it\nand/or modify it under the terms of the GNU General\nPublic License as published by the Free Software\nFoundation, either version 3 of the License, or\n(at your option) any later version.\n"
    rows = [
        ("/p/LICENSE", "Copyright (c) 2020 Some One\n\n" + wrap(text["MIT"], 11)),
        ("/p/deep/code.py", "x = 1"),
        ("/q/code.py", "".join(f"# {line}\n" for line in header.split("\n")) + "other words of code and more of them here\n" * 60),
        ("/r/BSD", wrap(text["BSD-2-Clause"], 9)),
        ("/r/BSD3", wrap(text["BSD-3-Clause"], 9, " * ")),
        ("/s/same", "Released under the MIT License."),
        ("/s/same", "nothing"),
        (None, "Released under the MIT License."),
        ("/t/" + "d/" * 40 + "long", "word " * 50_000 + "\n" * 3000 + "Released under the ISC License."),
    ]
    files = spark.createDataFrame([(*r, 1, "x") for r in rows], "path string, text string, cosine int, own string")
    got = [(r.path, r.license, r.origin) for r in licenses.scan(files).collect()]
    assert sorted(got, key=str) == sorted([("/p/LICENSE", "MIT", "file"), ("/p/deep/code.py", "MIT", "inherited"), ("/q/code.py", "GPL-3.0", "header"), ("/r/BSD", "BSD-2-Clause", "file"), ("/r/BSD3", "BSD-3-Clause", "file"), ("/s/same", "MIT", "file"), ("/s/same", "MIT", "inherited"), (None, "MIT", "file"), (rows[-1][0], "ISC", "header")], key=str)


def test_tries_match_their_words():
    some = ["license", "licensed", "lice", "mit", "2.0", "2", "mine"]
    assert all(re.fullmatch(licenses.trie(some), w) for w in some)
    assert not any(re.fullmatch(licenses.trie(some), w) for w in ("licens", "mi", "2x0", "", "min"))


# 3 -----------------------------------------------------------------------------------------------

ITEM = "A train leaves Oldtown at 40 km per hour and Anna waits for it during 15 minutes near the old bridge"


def test_leaks_of_all_kinds(spark):
    changed = ITEM.replace("40", "75").replace("15", "22").replace("Anna", "Peter")
    table = [(1, "Before it. " + ITEM + " and after", 0), (2, "x " + changed, 0), (3, "nothing of the kind at all here", 0), (4, None, 0), (5, "", 0), (6, "1 2 3 4 5 6 7 8 9 10 11 12", 0), (None, ITEM, 0), (1, "Before it. " + ITEM + " and after", 0), (7, "two words", 0)]
    docs = spark.createDataFrame(table, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "two words"), (None, ITEM), (1, ITEM)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.kind) for r in decontam.contaminated(docs, bench).collect())
    assert got == [(1, 1, "verbatim"), (2, 1, "reparameterised"), (7, 4, "verbatim")]
    assert decontam.contaminated(docs, bench, batch=3).count() == 3
    assert sorted(r.doc_id or 0 for r in decontam.decontaminate(docs, bench).collect()) == [0, 3, 4, 5, 6]


def test_inconsistent_slots_are_no_leak(spark):
    item = "alpha beta gamma 10 delta epsilon zeta 10 eta theta iota 20 kappa lambda mu nu"
    wrong = "alpha beta gamma 11 delta epsilon zeta 12 eta theta iota 13 kappa lambda mu nu"
    right = "alpha beta gamma 11 delta epsilon zeta 11 eta theta iota 13 kappa lambda mu nu"
    docs = spark.createDataFrame([(1, wrong), (2, right)], "doc_id long, text string")
    got = decontam.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [r.doc_id for r in got] == [2]


def test_slots_are_checked_one_way_and_over_a_whole_copy(spark):
    item = "alpha beta gamma 3 delta epsilon zeta 4 eta theta iota 5 kappa lambda mu nu"
    put = lambda a, b, c: item.replace(" 3 ", f" {a} ").replace(" 4 ", f" {b} ").replace(" 5 ", f" {c} ")
    slipped = item.replace("delta", "delta extra")
    twice = "alpha beta gamma 7 delta epsilon zeta 7 eta theta iota 9 kappa lambda mu nu"
    texts = [put(5, 5, 9), put(4, 4, 4), slipped, put(8, 6, 7) + " . far away " * 9 + put(1, 2, 3), twice.replace("delta", "delta extra")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted((r.doc_id, r.kind) for r in decontam.contaminated(docs, bench, coverage=0.5).collect()) == [(0, "reparameterised"), (1, "reparameterised"), (2, "verbatim"), (3, "reparameterised"), (4, "reparameterised")]
    # one value of the item stands for two of the document, on two diagonals of one copy
    same = item.replace(" 4 ", " 3 ")
    broken = same.replace(" 3 delta", " 6 delta extra").replace("zeta 3", "zeta 8")
    got = decontam.contaminated(spark.createDataFrame([(0, broken)], "doc_id long, text string"), spark.createDataFrame([(1, same)], "item_id long, text string"), coverage=0.5)
    assert got.count() == 0


def test_long_repetitive_texts_take_linear_time(spark):
    import time

    text = "in the year 7 of our house there were many good people " * 2200
    docs = spark.createDataFrame([(1, text, "x", 1)], "doc_id long, text string, h string, pos int")
    bench = spark.createDataFrame([(1, "in the year 7 of our house there were many good people")], "item_id long, text string")
    decontam.contaminated(docs.selectExpr("doc_id", "left(text, 5000) as text"), bench).count()  # compiles
    begin = time.perf_counter()
    assert decontam.contaminated(docs, bench).count() == 1
    assert time.perf_counter() - begin < 20  # the square of its words took minutes
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.contaminated(docs.limit(0), bench).count() == 0


# 4 -----------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] if ws else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(pairs):
    up = {}
    fps = sorted(set(pairs.values()))
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= 2:
                up[find(a)] = find(b)
    low = {}
    for d, f in pairs.items():
        low[find(f)] = min(low.get(find(f), d), d)
    return {d: low[find(f)] for d, f in pairs.items()}


def test_fingerprints_and_components(spark, docs, rows):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = {d: brute_fingerprint(t) for d, t, *_ in rows if d is not None}
    named = brute_components(want)
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{want[r.doc_id]:016x}", named[r.doc_id])
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = [r.doc_id for r in simhash.representatives(docs).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(set(named.values()))


@pytest.mark.parametrize("cell_pairs", [2, 24])
def test_links_join_up_what_brute_force_does(spark, cell_pairs):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:12]:
        for _ in range(14):  # clouds around a centre, so that cells fill
            g = f
            for _ in range(rng.randint(1, 4)):
                g ^= 1 << rng.randint(0, 63)
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), cell_pairs=cell_pairs)
    mask = (1 << 64) - 1
    assert all(bin((e.a & mask) ^ (e.b & mask)).count("1") <= 2 for e in edges.collect())
    label = {r.node: r.label for r in simhash.components(edges).collect()}
    want = brute_components({f: f & mask for f in signed})
    assert {f: label.get(f, f) for f in signed} == want


def test_components_of_a_long_chain(spark):
    order = list(range(300))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(order, order[1:])], "a long, b long")
    assert {r.label for r in simhash.components(edges).collect()} == {0}


# 5 -----------------------------------------------------------------------------------------------


def test_token_counts_are_the_librarys(spark, docs, rows):
    from tokenizers import Tokenizer

    from corpusloom.llm.common import resource_path

    rng = random.Random(5)
    alphabet = "ab'st  \n\t\r\x0b\x1c\x85\xa0 é²½ª_1٣漢🙂́.,-ß"
    texts = [t for _, t, *_ in rows] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["a <|endoftext|> b", "<|endoftext|>" * 3, "x" * 5000, "it's we'll"]
    library = Tokenizer.from_file(resource_path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in tokens.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 512), t
    assert tokens.token_counts(empty(spark)).count() == 0


def test_all_scripts_use_both_tiers():
    arabic = "ذهب الولد إلى المدرسة ثم عاد إلى البيت "
    curly = "“It’s the same thing,” she said — the very same thing… and €5. "
    frequent = tokens.frequent_lengths((arabic + curly).split(), "byte_bpe_50k.json")
    for text in (arabic * 50, curly * 50, (arabic + "عربي جديد ") * 20):
        count = tokens.TokenCounter("byte_bpe_50k.json", frequent)
        assert count(text) == len(count.library.encode(text, add_special_tokens=False).ids)
        assert count.asked > 100 and count.encoded <= 6  # all but a few pre-tokens come from the tiers
    count = tokens.TokenCounter("byte_bpe_50k.json")
    count("x" * 5000 + " " + "y" * 9000)
    assert max(map(len, count.lengths), default=0) <= tokens.KEPT


# 6 -----------------------------------------------------------------------------------------------


def test_highest_quotients(spark):
    votes = [("a", 53_000.0), ("b", 24_000.0), ("c", 23_000.0), ("d", 0.0)]
    for seats in (0, 1, 7, 10, 99):
        table = spark.createDataFrame([(0, n, v, seats) for n, v in votes], "g int, name string, votes double, seats long")
        got = {r.name: r.quota for r in mixing.apportion(table, ["g"], ["name"]).collect()}
        want = Counter()
        for _ in range(seats):
            want[max(votes, key=lambda x: (x[1] / (2 * want[x[0]] + 1), [-ord(c) for c in x[0]]))[0]] += 1
        assert got == {n: want[n] for n, _ in votes}


def test_mix_meets_its_targets(spark, docs, rows):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    size = Counter()
    for _, t, _, s, *_ in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] > 2 * size[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * size[s]
            free.remove(s)
            left -= target[s]
    target |= share
    assert {round(r.target, 6) for r in got} == {round(target[s], 6) for s in names}
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[round(r.target, 6)] += r.taken
    for s in names:
        assert abs(taken[round(target[s], 6)] - sum(target[x] for x in names if round(target[x], 6) == round(target[s], 6))) <= 40
    assert mixing.mix(empty(spark)).count() == 0


# 7 -----------------------------------------------------------------------------------------------

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_are_the_patterns():
    rng = random.Random(6)
    for _ in range(30_000):
        text = "".join(rng.choice("0123456789.@ +-()ab%é") for _ in range(rng.randint(0, 50)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+" * 100_000, "1 " * 100_000):
        pii.base_spans(text)


def test_the_field_generalises_and_keeps_base_spans(spark, docs, rows):
    field = pii.Field(pii.train())
    right = wrong = missed = 0
    for text, gold in pii.sentences(150, seed=77):
        found = {s for a, b in pii.islands(text) for s in field.decode(pii.starts(text, a, b))}
        right, wrong, missed = right + len(found & set(gold)), wrong + len(found - set(gold)), missed + len(set(gold) - found)
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.9
    got = pii.find(docs).collect()
    assert len(got) == len(rows) and pii.find(empty(spark)).count() == 0
    assert pii.mask(field, "mail x.y@a.example.com or 10.0.0.1 now") == "mail <EMAIL> or <IP> now"


#: Written by hand; forms and words that the generator of the training sentences does not make.
ODD_FORMS = [
    ("Ring Maria tomorrow, phone 0171 496 0123 after six.", ["0171 496 0123"]),
    ("You may call us at 555.867.5309 any time", ["555.867.5309"]),
    ("fax: (020) 7946 0958, thanks", ["(020) 7946 0958"]),
    ("write to j.smith [at] mail-server [dot] co [dot] uk please", ["j.smith [at] mail-server [dot] co [dot] uk"]),
    ("contact anna(at)example(dot)org for keys", ["anna(at)example(dot)org"]),
    ("the server 192.168[.]0[.]17 was down", ["192.168[.]0[.]17"]),
    ("charged to visa 4111.1111.1111.1111 on Monday", ["4111.1111.1111.1111"]),
    ("mobile 0049 151 234 5678 or mail me", ["0049 151 234 5678"]),
    ("Born 1987-04-12, moved 2003-11-30.", []),
    ("Version 3.14.15 costs 1,299.00 euros and weighs 12 kg", []),
    ("Rooms 101 102 103 104 are on floor 1; pages 233-245", []),
    ("ISBN 978-3-16-148410-0 was printed 5000 times", []),
    ("He was at home at 10:30 and at work at 11:45.", []),
    ("Order 2024-000123-77 shipped in 3 boxes of 48", []),
]


def test_the_field_on_forms_it_was_not_trained_on():
    field, hit, made, due = pii.Field(pii.train()), 0, 0, 0
    for text, want in ODD_FORMS:
        added = {text[a:b] for a, _, b in pii.added_spans(field, text, pii.base_spans(text))}
        hit, made, due = hit + len(added & set(want)), made + len(added), due + len(want)
    print(f"precision {hit}/{made}, recall {hit}/{due}")
    assert hit >= 0.8 * made and hit >= 0.6 * due


def brute_decode(field, n, segments):
    """The best segmentation by trying all."""
    by: dict = {}
    for s in segments:
        by.setdefault(s[0], []).append(s)

    def rest(i, last):
        if i == n:
            return 0.0, ()
        out = [rest(i + 1, None)]
        for s in by.get(i, ()):
            value, chosen = rest(s[1], s[2])
            out.append((value + sum(field.weights[f] for f in s[3]) + (field.weights[field.pair(last, s[2])] if last is not None else 0.0), ((s[4], s[2], s[5]), *chosen)))
        return max(out)

    return rest(0, None)[0]


def test_decoding_finds_the_best_segmentation():
    field, rng = pii.Field(pii.train()), random.Random(3)
    for _ in range(60):
        text = " ".join(rng.choice(["call", "12", "555", "1234", "x", "+4", "(20)", "10.0.0.1", "a@b.co", "4111"]) for _ in range(7))
        n, segments = pii.candidates(text, 0, len(text))
        found = field.decode(pii.starts(text, 0, len(text)))
        by = {(s[4], s[2], s[5]): s for s in segments}
        total, before = 0.0, None
        for s in (by[x] for x in found):
            total += sum(field.weights[f] for f in s[3])
            total += field.weights[field.pair(before[2], s[2])] if before and before[1] == s[0] else 0.0
            before = s
        assert math.isclose(total, brute_decode(field, n, segments), abs_tol=1e-9), text


def test_islands_end_at_white_space():
    text = "w" * 300 + " " + "abc " * 60 + "7" + " abc" * 60 + " " + "v" * 300
    (a, b), = pii.islands(text)
    assert text[a - 1].isspace() and text[b].isspace() and text[a:b].strip("abc ") == "7"


def test_a_megabyte_of_digits_takes_little_memory():
    import tracemalloc

    field, rng = pii.Field(pii.train()), random.Random(1)
    text = " ".join(str(rng.randint(0, 99999)) for _ in range(30_000))
    tracemalloc.start()
    pii.spans_of(field, text)
    one = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert one < 200 * len(text)  # 200 MB for a megabyte


def test_masking_keeps_rows_and_columns(spark, docs, rows):
    got = pii.masked(docs)
    assert got.columns == docs.columns and got.count() == len(rows)


# 8 -----------------------------------------------------------------------------------------------


def toxic_table(spark, n=1200):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.25
        ws = words(rng, rng.randint(10, 120)).split()
        if bad:
            for _ in range(rng.randint(1, 3)):
                ws.insert(rng.randint(0, len(ws)), rng.choice(["grobnik", "zuvrat", "prultig"]))
        rows.append((i, " ".join(ws)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((i, t) for i, _, t in labels)


def test_held_out_accuracy(spark):
    docs, labels, truth = toxic_table(spark)
    got = toxicity.score(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in got)


def test_scores_without_labels(spark, docs, rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, none).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {0.5}
    odd = spark.createDataFrame([(None, 1, 1), (1, 1, None), (2, 1, 0), (2, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, odd).count() == len(rows)
    assert toxicity.score(empty(spark), none).count() == 0


# 9 -----------------------------------------------------------------------------------------------


def test_base_scores_and_probabilities(spark, docs, rows):
    got = {(r.doc_id, r.n_tokens): r for r in lm.scores(docs, frequent=5).collect()}
    split = lambda t: lm.split_words((t or "").encode()) + [b" "]
    crc = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10
    count = Counter(w for d, t, *_ in rows if crc(d) for w in split(t))
    n, v = sum(count.values()), len(count)
    for d, t, *_ in rows:
        ws = split(t)
        r = got[d, len(ws)]
        assert r.train_tokens == n and r.held_out == (crc(d) == 0) and r.n_known == sum(count[w] > 0 for w in ws)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)


def test_no_rows_to_learn_from(spark):
    assert lm.scores(empty(spark)).count() == 0


def little_vocabulary(texts):
    """The vocabulary that ``learn_vocabulary`` makes, counted in plain loops, and the subwords."""
    subwords = lm.Subwords()
    single, pairs, stops = np.zeros(subwords.size + 1), Counter(), Counter()
    for text in texts:
        for w in text:
            ids = np.frombuffer(subwords.ids(w), np.int32).tolist()
            for i in ids:
                single[i] += 1
            pairs.update(zip(ids, ids[1:]))
            stops[ids[-1]] += 1
    held = [np.array(x, np.int64) for x in ([a for a, _ in pairs], [b for _, b in pairs], list(pairs.values()))]
    voc = lm.Vocabulary(single, subwords.beginning, *held)
    voc.pair(*held)
    voc.follow(np.array([*held[0], *stops]), np.array([*voc.classes[held[1]], *[-1] * len(stops)]), np.array([*held[2], *stops.values()]))
    return subwords, voc, single


def little_texts():
    return [[*words(random.Random(i), n).encode().split(), lm.END] for i, n in enumerate((0, 1, 9, 40, 333))]


def test_every_pair_inside_a_word_is_held(spark, monkeypatch):
    monkeypatch.setattr(lm, "PAIRS", 3, raising=False)
    texts = little_texts()
    _, want, _ = little_vocabulary(texts)
    frame = spark.createDataFrame([(bytearray(b" ".join(t[:-1])),) for t in texts], "t binary")
    got = lm.learn_vocabulary(lm.packed(lm.word_counts(frame)))
    assert len(want.keys) > 3 and (got.keys == want.keys).all() and (got.pairs == want.pairs).all() and (got.totals == want.totals).all()


def test_slope_is_the_losses_derivative():
    model, rng = lm.Attention(), np.random.default_rng(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y = rng.integers(0, 50, (2, lm.WINDOW)), rng.integers(0, lm.CLASSES, (2, lm.WINDOW))
    bias = rng.standard_normal((2 * lm.WINDOW, lm.CLASSES))
    weight = rng.integers(0, 2, (2, lm.WINDOW)).astype(float)

    def loss():
        logits = model.forward(x, bias)[-1].reshape(2, lm.WINDOW, -1)
        top = logits - logits.max(axis=-1, keepdims=True)
        logs = np.take_along_axis(top, y[..., None], -1)[..., 0] - np.log(np.exp(top).sum(axis=-1))
        return -(logs * weight).sum() / weight.sum()

    slope = model.slope(x, bias, y, weight)
    for name, at in (("qkv", (3, 5)), ("qkv", (2, 10)), ("qkv", (1, 20)), ("o", (4, 4)), ("u", (2, 7)), ("e", (int(x[0, 3]), 2)), ("pos", (4, 1)), ("b", (9,))):
        old = model.p[name][at]
        model.p[name][at] = old + 1e-5
        up = loss()
        model.p[name][at] = old - 1e-5
        down = loss()
        model.p[name][at] = old
        assert math.isclose(slope[name][at], (up - down) / 2e-5, rel_tol=1e-3, abs_tol=1e-7), name


def test_training_takes_every_subword_of_every_text():
    texts = little_texts()
    subwords, voc, _ = little_vocabulary(texts)
    seen = []
    trainer = lm.Trainer(lm.Attention(), voc, 0.01)
    trainer.step = lambda before, ids, weight: seen.append((before[weight > 0], ids[weight > 0]))
    store = lm.Words(subwords)
    for i in range(0, len(texts), 2):
        trainer.add(store.flat(store.slots([w for t in texts[i : i + 2] for w in t]))[0])
    trainer.flush()
    want = [i for t in texts for w in t for i in np.frombuffer(subwords.ids(w), np.int32).tolist()]
    assert Counter(np.concatenate([s for _, s in seen]).tolist()) == Counter(want)


def test_training_lowers_the_loss_and_weights_average_in_a_tree(spark):
    texts = little_texts() * 30
    subwords, voc, _ = little_vocabulary(texts)
    store, model = lm.Words(subwords), lm.Attention()
    trainer = lm.Trainer(model, voc, 0.03)
    ids = store.flat(store.slots([w for t in texts for w in t]))[0]
    windows = ids[: len(ids) // lm.WINDOW * lm.WINDOW].reshape(-1, lm.WINDOW)
    before = np.concatenate([[voc.size - 1], windows.ravel()[:-1]]).reshape(windows.shape)
    loss = lambda: -model.log_classes(voc.inputs[before], voc.bias[before.ravel()], voc.classes[windows])[0].mean()
    old = loss()
    for _ in range(20):
        trainer.add(ids)
    trainer.flush()
    assert loss() < old
    parts = [(k, 1 + k % 3, np.full(4, float(k), np.float32).tobytes()) for k in range(150)]
    got = np.frombuffer(lm.averaged(spark.createDataFrame(parts, "k long, n long, blob binary"), fan=4), np.float32)
    assert np.allclose(got, np.average(range(150), weights=[1 + k % 3 for k in range(150)]), rtol=1e-4)
    assert lm.averaged(spark.createDataFrame([], "k long, n long, blob binary")) is None


@pytest.mark.parametrize("mix", [1e-9, 0.5])
def test_scores_are_the_models_probabilities_one_subword_at_a_time(mix):
    texts = little_texts()
    subwords, voc, single = little_vocabulary(texts)
    model = lm.Attention()
    rng = np.random.default_rng(5)
    model.p = {k: (v + rng.standard_normal(v.shape) * 0.3).astype(np.float32) for k, v in model.p.items()}
    tier = [w for w, _ in Counter(w for t in texts for w in t).most_common(30)]
    count = Counter(w for t in texts for w in t)
    share = np.array([count[w] / sum(count.values()) for w in tier])
    packed = list(map(subwords.ids, tier))
    scorer = lm.Scorer(voc, model, np.log(share), np.array([np.frombuffer(p, np.int32)[0] for p in packed]), mix)
    store = lm.Words(subwords, tier, packed, voc.within)
    got = scorer(store, store.slots([w for t in texts for w in t]), np.array(list(map(len, texts))))

    pair = {}
    for t in texts:
        for w in t:
            ids = np.frombuffer(subwords.ids(w), np.int32).tolist()
            for a, b in zip(ids, ids[1:]):
                pair[a, b] = pair.get((a, b), 0) + 1
    alone = lambda i: (single[i] + 0.1) / sum(single[j] + 0.1 for j in members[voc.classes[i]])
    members = {k: np.flatnonzero(voc.classes == k) for k in range(lm.CLASSES)}
    cache = {}

    def single_odds(i):
        return cache.setdefault(i, alone(i))

    def classes_after(context):
        """Softmax over classes with the context's last WINDOW subwords as ``scores`` windows them."""
        pos = len(context) - 1  # place of the target in its text
        step = lm.WINDOW - lm.CONTEXT
        k = 0 if pos < lm.WINDOW else (pos - lm.CONTEXT) // step
        own = np.array(context[k * step : pos + 1])
        e = model.p["e"][voc.inputs[own]] + model.p["pos"][: len(own)]
        q, key, v = np.split(e @ model.p["qkv"], 3, axis=1)
        a = np.exp(q[-1] @ key.T / math.sqrt(lm.WIDTH))
        h = e[-1] + (a / a.sum()) @ v @ model.p["o"]
        z = np.exp((h @ model.p["u"] + model.p["b"] + voc.bias[own[-1]]).astype(np.float64))
        return z / z.sum()

    kind_share = np.zeros(lm.CLASSES)
    for w, s in zip(tier, share):
        kind_share[voc.classes[np.frombuffer(subwords.ids(w), np.int32)[0]]] += s
    for t, score in zip(texts, got):
        context, total = [voc.size - 1], 0.0
        p = classes_after(context)
        total += math.log(p[: lm.BEGINNING].sum())
        for nth, w in enumerate(t):
            ids = np.frombuffer(subwords.ids(w), np.int32).tolist()
            opening = p[voc.classes[ids[0]]] / p[: lm.BEGINNING].sum()
            spelt = opening * single_odds(ids[0])
            for a, b in zip(ids, ids[1:]):
                context.append(a)
                p = classes_after(context)
                row = sum(n for (x, y), n in pair.items() if x == a and voc.classes[y] == voc.classes[b])
                spelt *= p[voc.classes[b]] * (pair.get((a, b), 0) + lm.STRENGTH * single_odds(b)) / (row + lm.STRENGTH)
            context.append(ids[-1])
            if nth + 1 < len(t):
                p = classes_after(context)
                spelt *= p[: lm.BEGINNING].sum()
            listed = opening * share[tier.index(w)] / kind_share[voc.classes[ids[0]]] if w in tier else 0.0
            total += math.log(mix * listed + (1 - mix) * spelt)
        assert math.isclose(score, total / math.log(10), rel_tol=1e-4)


def test_odds_sum_to_one():
    texts = little_texts()
    _, voc, _ = little_vocabulary(texts)
    assert np.allclose(np.exp(voc.bias).sum(axis=1), 1, atol=1e-3)
    for ids in (np.flatnonzero(voc.classes == k) for k in range(lm.BEGINNING, lm.CLASSES)):
        before = 300
        pairs = np.column_stack([np.full(len(ids), before), ids]).ravel()
        assert np.isclose(np.exp(voc.within(pairs, np.arange(0, len(pairs), 2)) - np.log(voc.single[before])).sum(), 1, atol=1e-6)


def test_forgotten_words_are_learnt_again(monkeypatch):
    monkeypatch.setattr(lm, "CACHE_BYTES", 2000)
    subwords = lm.Subwords()
    tier = [b"the", lm.END]
    store = lm.Words(subwords, tier, list(map(subwords.ids, tier)))
    rng = random.Random(2)
    for _ in range(40):
        some = [rng.choice([b"the", lm.END, b"w%d" % rng.randint(0, 500), b"x" * 700]) for _ in range(30)]
        ids, first = store.flat(store.slots(some))
        assert ids.tobytes() == b"".join(map(subwords.ids, some)) and len(first) == len(some)


# 10 ----------------------------------------------------------------------------------------------


def test_round_trip_with_small_splits(spark):
    import base64
    import hashlib

    rng = random.Random(10)
    page = "<p>" + words(rng, 900)
    table = [(i, f"http://a.example/{i}", page if i % 3 == 0 else f"<p>{i}" + words(rng, rng.randint(0, 400))) for i in range(90)]
    table += [(500, None, None), (501, "u", ""), (7, "again", table[7][2]), (None, "n", "no id"), (600, "bytes", "\x1f\x8b\x08 é ü " * 9)]
    pages = spark.createDataFrame(table, "page_id long, url string, html string").repartition(3)
    want = []
    largest = {}
    for i, _, h in table:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", i), i)
    for i, _, h in table:
        data = (h or "").encode()
        owner = largest.get(h or "")
        revisit = owner is not None and (i is None or i < owner)
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", owner if revisit else None))
    for split in (300, 1 << 20):
        got = [tuple(r) for r in warc.round_trip(pages, split=split).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_small_payloads_stay_responses(spark):
    pages = spark.createDataFrame([(1, "u", "same"), (2, "u", "same"), (3, "u", "long " * 20), (4, "u", "long " * 20)], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.round_trip(pages, least=10).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
