"""Near copies by the Jaccard of word shingles: SimHash and min-hash candidates, then an exact check.

Texts with the same shingles are one class. Classes whose SimHash fingerprints (over their shingles)
the grid join of ``simhash`` finds within two bits are candidates; that is exact for its radius but
reaches only copies of a few per cent, since a pair of Jaccard 0.8 differs in ten bits or so. For the
rest a class has 32 keys of four minima each; two classes of Jaccard 0.8 share none of them with a
probability of 5e-8 (less above), and only that can lose a pair. Each class is compared with the
smallest and largest of every key it has, which is linear in a large group and mostly joins it up.
Of the classes of a key that are still apart, a few are compared pair by pair. Many of them (pages of
one template, say, each with words of its own) meet by their rarest shingles instead, as far as a
pair of the threshold has to share one of these: exact, and without pairs where what they share is
the template. Only classes that meet another are moved with their shingles.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_batches, text_bytes, written
from corpusloom.llm.simhash import SEED, components, links, one_of_each

WORDS, JACCARD = 5, 0.8
BANDS, MINIMA = 32, 4
#: Classes of one key that are compared pair by pair; more meet by their rarest shingles.
FEW = 16
#: Shingles whose minima are taken at once.
BLOCK = 4096
#: Places of a class's bitmap.
PLACES = 1024


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of lower-cased text; fewer words make one shingle."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(tokens[i:] for i in range(words)))) if len(tokens) >= words else [b" ".join(tokens)]
    return np.unique(np.fromiter(map(functools.partial(xxhash.xxh64_intdigest, seed=SEED), grams), np.uint64))


def class_key(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED)


@functools.cache
def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = rng.integers(0, 1 << 63, (2, BANDS * MINIMA, 1), dtype=np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def band_keys(own: np.ndarray) -> np.ndarray:
    """One key a band; none without shingles."""
    if not len(own):
        return np.empty(0, np.int64)
    factor, shift = _factors()
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), BLOCK):
        np.minimum(least, (own[at : at + BLOCK] * factor + shift).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, MINIMA))], np.uint64).view(np.int64)


def simhash(own: np.ndarray) -> int:
    """64-bit SimHash of distinct shingle hashes."""
    if not len(own):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(own), 1 << 14):
        ones += np.unpackbits(own[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(own)).tobytes(), "big", signed=True)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, th, fp, n, sh, keys) for every row: the text's hash, its class, its shingles, their SimHash and its band keys."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            sets = [shingles(t.as_py(), words) for t in batch.column(2)]
            fps = np.array([class_key(s) for s in sets], np.uint64).view(np.int64)
            keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            arrays = [batch.column(0), batch.column(1), pa.array(fps), pa.array([len(s) for s in sets], pa.int64()), pa.array([simhash(s) for s in sets], pa.int64()), keys]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "th", "fp", "n", "sh", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), text_bytes().alias("t")).mapInArrow(run, "doc_id long, th long, fp long, n long, sh long, keys array<long>")


def shingle_sets(docs: DataFrame, owners: DataFrame, words: int = WORDS) -> DataFrame:
    """(fp, s): the shingles of each class of ``owners`` (fp, doc_id, th), which names one row of it; rows that repeat may come out again."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        seen: set = set()
        for batch in batches:
            fps = batch.column(0).to_pylist()
            new = [i for i, fp in enumerate(fps) if not (fp in seen or seen.add(fp))]
            yield pa.RecordBatch.from_arrays([pa.array([fps[i] for i in new], pa.int64()), pa.array([shingles(batch.column(1)[i].as_py(), words).tobytes() for i in new], pa.binary())], ["fp", "s"])

    own = owners.select("fp", F.col("doc_id").alias("_d"), F.col("th").alias("_th"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.join(own, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_th")))
    return rows.select("fp", text_bytes().alias("t")).mapInArrow(run, "fp long, s binary")


def alike(classes: DataFrame) -> DataFrame:
    """(a, b): pairs that join up the classes (fp, sh) whose SimHash fingerprints lie within two bits."""
    named = written(classes.groupBy("sh").agg(F.min("fp").alias("low")), "named")
    same = classes.join(named, "sh").where("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b"))
    near = links(named.select(F.col("sh").alias("fp")))
    one, two = named.toDF("a", "la"), named.toDF("b", "lb")
    near = near.join(one, "a").join(two, "b").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
    return same.unionByName(near)


def verified(pairs: DataFrame, sets: DataFrame, jaccard: float = JACCARD) -> DataFrame:
    """(a, b): the ``pairs`` whose shingles have a Jaccard of ``jaccard`` or more."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= jaccard * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(sets.select(F.col("fp").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("fp").alias("b"), F.col("s").alias("sb")), "b")
    return met.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def unpacked(sets: DataFrame) -> DataFrame:
    """(fp, h): a row for each shingle of ``sets`` (fp, s)."""

    def run(batches):
        for batch in batches:
            for fp, s in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(s.as_buffer(), np.int64)
                for at in range(0, len(own), 1 << 16):
                    part = own[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), fp, np.int64)), pa.array(part)], ["fp", "h"])

    return sets.select("fp", "s").mapInArrow(run, "fp long, h long")


def bitmaps(sets: DataFrame) -> DataFrame:
    """(fp, bits): for each of ``PLACES`` whether an odd number of the shingles of ``sets`` (fp, s) falls on it; two classes differ in as many shingles as places at least."""

    def run(batches):
        for batch in batches:
            odd = [np.packbits(np.bincount(np.frombuffer(s.as_buffer(), np.uint64).view(np.int64) & (PLACES - 1), minlength=PLACES).astype(np.uint8) & 1).view(np.int64) for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(odd, pa.list_(pa.int64()))], ["fp", "bits"])

    return sets.select("fp", "s").mapInArrow(run, "fp long, bits array<long>")


def crowded(members: DataFrame, sets: DataFrame, jaccard: float = JACCARD) -> DataFrame:
    """(a, b): the pairs of ``members`` (fp, n, label) of two labels that can have a Jaccard of ``jaccard``; none that has it is missing.

    With the shingles of each class in one order, rarest first, such a pair shares one among the first
    n - ceil(j n) + 1 of the larger class and the first n - ceil(2 j n / (1 + j)) + 1 of the smaller;
    and where the first shared one stands says how many can follow. Shingles of one class alone only
    take up places. Pairs whose bitmaps differ in more places than the threshold lets shingles differ go.
    """
    own = written(sets.join(members.select("fp"), "fp"), "crowded")
    rows = written(unpacked(own), "shingles")
    shared = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    order = rows.join(shared, "h").groupBy("fp").agg(F.sort_array(F.collect_set(F.struct("df", "h"))).alias("o")).join(members, "fp")
    # a little less before rounding up, so that no rank is lost to the last digit
    reach = {side: F.col("n") - F.ceil(part * F.col("n") - 1e-9) + 1 for side, part in (("probe", jaccard), ("index", 2 * jaccard / (1 + jaccard)))}
    alone = F.col("n") - F.size("o")
    order = order.select("fp", "n", "label", alone.alias("alone"), reach["index"].alias("index"), F.slice("o", 1, F.greatest(F.lit(0), reach["probe"] - alone).cast("int")).alias("o")).where("size(o) > 0")
    order = order.join(bitmaps(own), "fp").select("fp", "n", "label", "alone", "index", "bits", F.posexplode("o").alias("i", "e"))
    order = written(order.select("fp", "n", "label", "index", "bits", (F.col("alone") + F.col("i") + 1).alias("rank"), F.col("e.h").alias("h")), "rarest")
    small = order.where("rank <= index").select("h", F.col("fp").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"), F.col("rank").alias("ra"), F.col("bits").alias("xa"))
    large = order.select("h", F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"), F.col("rank").alias("rb"), F.col("bits").alias("xb"))
    fit = (F.col("na") >= jaccard * F.col("nb") - 1e-9) & (1 + F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb")) >= jaccard / (1 + jaccard) * (F.col("na") + F.col("nb")) - 1e-9)
    differ = F.aggregate(F.zip_with("xa", "xb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = differ <= (1 - jaccard) / (1 + jaccard) * (F.col("na") + F.col("nb")) + 1e-9
    found = small.join(large, "h").where("a <> b and la <> lb and na <= nb").where(fit).where(near)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked(docs: DataFrame, words: int = WORDS, jaccard: float = JACCARD) -> DataFrame:
    """(doc_id, th, label) for every row of ``docs``: rows of one label are near copies, directly or by others."""
    marked = written(signatures(docs, words), "signatures")
    classes = marked.groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("o"), F.first("n").alias("n"), F.first("sh").alias("sh"), F.first("keys").alias("keys"))
    classes = written(classes.where("n > 0").select("fp", "o.doc_id", "o.th", "n", "sh", "keys"), "classes")
    dealt = classes.select("fp", "n", F.explode("keys").alias("key"))
    # keys that two classes have: few, and a table, so that its size decides how it is joined
    ends = written(dealt.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high"), "ends")
    met = written(dealt.join(ends, "key"), "met")
    twins = written(alike(classes.select("fp", "sh")), "twins")
    if met.isEmpty() and twins.isEmpty():
        return marked.select("doc_id", "th", F.col("fp").alias("label"))
    star = met.select("fp", F.explode(F.array("low", "high")).alias("end")).where("fp <> end").select(F.least("fp", "end").alias("a"), F.greatest("fp", "end").alias("b"))
    star = written(star.unionByName(twins).distinct(), "star")
    named = star.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    owners = written(classes.select("fp", "doc_id", "th").join(named, "fp"), "owners")
    sets = written(shingle_sets(docs, owners, words), "sets")

    edges = written(verified(star, sets, jaccard), "links")
    label = owners.select("fp", F.col("fp").alias("label"))
    if not edges.isEmpty():
        named = components(edges)
        label = label.join(named.select(F.col("node").alias("fp"), F.col("label").alias("l")), "fp", "left").select("fp", F.coalesce("l", "label").alias("label"))
    label = written(label, "labels")

    apart = met.select("key", "fp", "n").join(label, "fp")
    mixed = apart.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("members")).where("x <> y").select("key", "members")
    apart = written(apart.join(mixed, "key"), "apart")
    few = apart.where(F.col("members") <= FEW)
    one = few.select("key", F.col("fp").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
    two = few.select("key", F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    fit = F.least("na", "nb") >= F.lit(jaccard) * F.greatest("na", "nb")
    rest = one.join(two, "key").where("a < b and la <> lb").where(fit).select("a", "b")
    many = written(apart.where(F.col("members") > FEW).select("fp", "n", "label").distinct(), "crowd")
    if not many.isEmpty():
        rest = rest.unionByName(crowded(many, sets, jaccard))
    rest = rest.distinct()
    more = written(verified(rest, sets, jaccard), "links")
    if not more.isEmpty():
        label = components(edges.unionByName(more)).select(F.col("node").alias("fp"), "label")
    named = label.select(F.col("fp").alias("_fp"), F.col("label").alias("l"))
    return marked.join(named, F.col("fp") == F.col("_fp"), "left").select("doc_id", "th", F.coalesce("l", "fp").alias("label"))


def representatives(docs: DataFrame, words: int = WORDS, jaccard: float = JACCARD) -> DataFrame:
    """``docs`` with one row of each set of near copies, see ``one_of_each``."""
    return one_of_each(docs, linked(docs, words, jaccard))
