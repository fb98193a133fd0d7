"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is cut into 16 segments of 4 bits; the 16 bit counts are its point. One flipped bit
moves a point by one unit, so the Manhattan distance of two points never exceeds the Hamming distance
of their fingerprints. Fingerprints within two bits therefore lie within two units and share a grid
cell that is at most one unit from either: each fingerprint is dealt to its own cell and the up to 32
next to it, and an equi-join on cells finds every candidate. Candidates are then verified on the bits.

A cell with many fingerprints would emit a square of pairs. There the common cell is refined by the
word half way between two fingerprints: a member stands for the (at most four) words one flip away
that lie in that cell, and fingerprints that share a word differ in two bits at most. Such a group
has 65 members at most, so it links as a star. Nothing is dropped and no group is unbounded.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_batches, text_bytes, written

SEGMENTS, WIDTH = 16, 4
SEED = 42
#: Cells with more fingerprints than this are refined before pairs are made.
CELL_PAIRS = 24


def text_fingerprint(text: bytes, words: int = 3) -> bytes:
    """Big-endian 64-bit SimHash of the word shingles of lower-cased text; zero without words."""
    tokens = text.lower().split()
    if not tokens:
        return bytes(8)
    digest = functools.partial(xxhash.xxh64_digest, seed=SEED)
    if len(tokens) < words:
        return digest(b" ".join(tokens))
    shingles = zip(*(tokens[i:] for i in range(words)))
    bits = np.frombuffer(b"".join(map(digest, map(b" ".join, shingles))), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(bits), 1 << 16):
        ones += np.unpackbits(bits[start : start + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(bits)).tobytes()


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp long): one row per document, null and wordless texts at zero."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = b"".join(text_fingerprint(t, words) for t in batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(fps, ">i8").astype(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("t")).mapInArrow(run, "doc_id long, fp long")


def cells(fps: DataFrame) -> DataFrame:
    """(fp, cell, step): the cells a fingerprint is dealt to.

    A cell packs the 16 counts three bits each. ``step`` is 0 for the own cell, else plus or minus
    the segment's number from 1 for one bit more or less there.
    """
    count = [F.bit_count(F.shiftrightunsigned("fp", WIDTH * s).bitwiseAND(F.lit(15).cast("long"))).cast("long") for s in range(SEGMENTS)]
    packed = functools.reduce(lambda a, b: a + b, [F.shiftleft(c, 3 * s) for s, c in enumerate(count)])
    point = fps.select("fp", packed.alias("own"), *[c.cast("byte").alias(f"c{s}") for s, c in enumerate(count)])
    steps = [F.struct(F.col("own").alias("cell"), F.lit(0).cast("byte").alias("step"))]
    for s in range(SEGMENTS):
        one = F.lit(1 << (3 * s)).cast("long")
        steps.append(F.when(F.col(f"c{s}") < WIDTH, F.struct((F.col("own") + one).alias("cell"), F.lit(s + 1).cast("byte").alias("step"))))
        steps.append(F.when(F.col(f"c{s}") > 0, F.struct((F.col("own") - one).alias("cell"), F.lit(-s - 1).cast("byte").alias("step"))))
    return point.select("fp", F.explode(F.array(*steps)).alias("x")).where("x is not null").select("fp", "x.cell", "x.step")


def _differ(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame, bits: int = 2, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """(a, b), a < b: verified links that join up every two of ``fps`` (distinct) within ``bits`` (2 at most)."""
    if not 0 <= bits <= 2:
        raise ValueError("the grid join covers radius 2")
    spark = fps.sparkSession
    dealt = cells(fps)
    counts = written(dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "cells")
    met = written(dealt.join(counts, "cell").select("cell", "fp", "step", (F.col("n") > cell_pairs).alias("full")), "met")

    pair = met.where("not full").groupBy("cell").agg(F.sort_array(F.collect_list("fp")).alias("g"))
    pair = pair.select(F.explode(F.expr("flatten(transform(g, (x, i) -> transform(slice(g, i + 2, size(g)), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b")

    # the words of the cell one flip (or none) away from a member; a flip up needs a zero bit there, a flip down a one
    bit = F.expr("shiftleft(1L, 4 * (abs(cast(step as int)) - 1) + k)")
    flip = met.where("full").withColumn("k", F.explode(F.when(F.col("step") == 0, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, range(WIDTH))))))
    flip = flip.withColumn("bit", bit).where("step = 0 or (step > 0) = ((fp & bit) = 0)")
    flip = flip.select("fp", F.when(F.col("step") == 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.col("bit"))).alias("word"))
    star = flip.groupBy("word").agg(F.array_distinct(F.sort_array(F.collect_list("fp"))).alias("g")).where("size(g) > 1")
    # with radius 2 a star to the smallest is enough; smaller radii need the group's (at most 65) members in pairs
    if bits == 2:
        star = star.select(F.col("g")[0].alias("a"), F.explode(F.expr("slice(g, 2, size(g))")).alias("b"))
    else:
        star = star.select(F.explode(F.expr("flatten(transform(g, (x, i) -> transform(slice(g, i + 2, size(g)), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b")
    found = pair.where(_differ("a", "b") <= bits).unionByName(star.where(_differ("a", "b") <= bits))
    return written(found.distinct(), "links")


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, label): the smallest node reachable, for the nodes of the undirected ``edges`` (a, b).

    Every round lets a node and its label adopt smaller labels met over an edge, then follows labels
    once; chains shorten by half at least, and only keyed minima and joins are used.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    label = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    for _ in range(rounds):
        lu = label.select(F.col("node").alias("a"), F.col("label").alias("la"))
        lv = label.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        met = edges.join(lu, "a").join(lv, "b").where("la <> lb").select("a", "b", "la", "lb", F.least("la", "lb").alias("low"))
        met = met.select(F.explode(F.array("a", "b", "la", "lb")).alias("node"), F.col("low").alias("label"))
        new = label.unionByName(met).groupBy("node").agg(F.min("label").alias("label"))
        new = written(new, "labels")
        jump = new.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = written(new.join(jump, "label").select("node", F.least("label", "far").alias("label")), "labels")
        lone = edges.join(after.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(after.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").where("la <> lb")
        label = after
        if lone.isEmpty():
            return label
    raise RuntimeError("labels did not settle")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    Null texts and texts without words have fingerprint zero and link like others. Rows that repeat
    come out as often as they came. Rows without a doc_id keep their fingerprint and follow its
    component, but never name one. Further columns are ignored; an empty table gives an empty result.
    """
    marked = written(fingerprints(docs, words), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    edges = links(classes.select("fp"), bits, cell_pairs)
    if edges.isEmpty():
        named = classes.select("fp", F.col("first").alias("component_id"))
    else:
        label = components(edges).withColumnRenamed("node", "fp")
        first = label.join(classes, "fp").groupBy("label").agg(F.min("first").alias("low"))
        low = label.join(first, "label").select("fp", "low")
        named = classes.join(low, "fp", "left").select("fp", F.coalesce("low", "first").alias("component_id"))
    named = written(named, "components")
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with one row of each label: its smallest doc_id, and of its rows with that one the smallest text hash.

    ``found`` (doc_id, th, label) has every row of ``docs``; th is the hash of its text, so rows that
    repeat a doc_id are told apart by it. All columns stay. Only rows that go are collected into a
    table, so documents that are alone are not moved with their texts unless that table is large.
    Rows without a doc_id stay.
    """
    found = written(found.where("doc_id is not null").groupBy("doc_id", "th", "label").agg(F.count(F.lit(1)).alias("n")), "kept")
    least = found.groupBy("label").agg(F.min(F.struct("doc_id", "th")).alias("least"))
    rows = found.join(least, "label").select("doc_id", "th", "n", (F.struct("doc_id", "th") == F.col("least")).alias("stays"))
    rows = written(rows.where("not stays or n > 1"), "gone")
    gone = rows.where("not stays").select(F.col("doc_id").alias("_gone"), F.col("th").alias("_th"))
    at = lambda side, name: (docs["doc_id"].cast("long") == side[name]) & (F.xxhash64(docs["text"]) == side["_th"])
    kept = docs.join(gone, at(gone, "_gone"), "left_anti")
    again = rows.where("stays").select(F.col("doc_id").alias("_again"), F.col("th").alias("_th"))
    if again.isEmpty():
        return kept
    names = kept.columns
    same = (kept["doc_id"].cast("long") == again["_again"]) & (F.xxhash64(kept["text"]) == again["_th"])
    once = kept.join(again, same, "left_anti")
    rest = kept.join(again, same, "left_semi")
    first = rest.groupBy("doc_id", F.xxhash64("text").alias("_h")).agg(F.min(F.struct(*[F.col(c) for c in names])).alias("_r"))
    return once.unionByName(first.select(*[F.col("_r")[c].alias(c) for c in names]))


def representatives(docs: DataFrame, words: int = 3, bits: int = 2, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """``docs`` with one row of each component: its smallest doc_id, and of rows repeating that one the smallest text.

    All columns stay. Only doc_ids that go are collected into a table, and rows are dropped by it, so
    documents that are alone are not moved with their texts unless that table is large. Rows without
    a doc_id stay.
    """
    found = written(near_duplicates(docs.select("doc_id", "text"), words, bits, cell_pairs).select("doc_id", "component_id"), "kept")
    gone = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    kept = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    again = written(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_again")).count().where("count > 1").select("_again"), "repeated")
    if again.isEmpty():
        return kept
    names = kept.columns
    once = kept.join(again, kept["doc_id"] == again["_again"], "left_anti")
    rest = kept.join(again, kept["doc_id"] == again["_again"], "left_semi")
    least = rest.groupBy("doc_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("_t"), *[F.col(c) for c in names])).alias("_r"))
    return once.unionByName(least.select(*[F.col("_r")[c].alias(c) for c in names]))
