"""Toxicity by class-conditional Kneser-Ney models over bytes.

A toxic and an ordinary model share their lowest order: pooled continuation counts of byte trigrams
smooth whatever is rare in either class. Above it each class has its own absolutely discounted
orders of five and seven bytes. n-grams count documents, not places, so a text that repeats itself
or is copied within itself weighs once. The per-byte log ratio is normalised by length over the
whole text and over short windows (a long text may hold one insult), and a logistic regression,
fitted on rows the counts have not seen, turns these into a score.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_batches, crc_remainder, text_bytes, written

#: The orders; the first is shared by the classes.
ORDERS = (3, 5, 7)
#: Bits of the buckets of hashed n-grams and contexts by length; the model is 17 MB whatever the sample.
BITS = {2: 18, 3: 18, 4: 19, 5: 19, 6: 20, 7: 21}
#: Probabilities are held in half precision, times this.
HALF = 1024
#: Buckets of a block: counts leave a task, meet and become a model block by block, 4 MB each.
BLOCK = 1 << 18
#: (order, first bucket) of each block.
BLOCKS = [(order, at) for order in ORDERS for at in range(0, 1 << BITS[order], BLOCK)]
DISCOUNT = 0.9
#: Bound of the labelled sample: documents of each class, those of the smallest hashes.
TOXIC_ROWS, ORDINARY_ROWS = 4000, 8000
#: Tasks that count the sample.
COUNTERS = 8
WINDOWS = (16, 64)
THRESHOLD = 0.3
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def prepared(text: bytes) -> np.ndarray:
    """Lower-cased bytes after seven spaces, with every run of white space as one space and one at the end."""
    return np.frombuffer(b"       " + b" ".join(text.decode("utf-8", "replace").lower().encode().split()) + b" ", np.uint8)


def hashes(data: np.ndarray) -> dict[int, np.ndarray]:
    """Buckets of the n-grams that end at each byte from the eighth on, by order; also those of their contexts (as order - 1).

    A word of 64 bits holds the eight bytes up to a place, the last one highest; shifts cut n-grams out.
    """
    wide = data.astype(np.uint64)
    wide = wide[:-1] | (wide[1:] << np.uint64(8))
    wide = wide[:-2] | (wide[2:] << np.uint64(16))
    wide = wide[:-4] | (wide[4:] << np.uint64(32))
    before = wide << np.uint64(8)
    out = {}
    for order in ORDERS:
        gram = wide >> np.uint64(64 - 8 * order)
        out[order] = ((gram * MULTIPLY) >> np.uint64(64 - BITS[order])).view(np.int64)
        gram = before >> np.uint64(64 - 8 * (order - 1))
        out[order - 1] = ((gram * MULTIPLY) >> np.uint64(64 - BITS[order - 1])).view(np.int64)
    return out


@dataclass
class Counts:
    """Documents of each class by bucket of each order, and the buckets of an n-gram's context and suffix."""

    n: dict = field(default_factory=dict)
    context: dict = field(default_factory=dict)
    suffix: dict = field(default_factory=dict)

    def __post_init__(self):
        for order in ORDERS:
            self.n[order] = np.zeros((2, 1 << BITS[order]), np.int32)
            self.context[order] = np.full(1 << BITS[order], -1, np.int32)
            self.suffix[order] = np.full(1 << BITS[order], -1, np.int32)

    def add(self, text: bytes, label: int) -> None:
        grams = hashes(prepared(text))
        for i, order in enumerate(ORDERS):
            own, first = np.unique(grams[order], return_index=True)
            self.n[order][label][own] += 1
            self.context[order][own] = np.maximum(self.context[order][own], grams[order - 1][first])
            if i:
                self.suffix[order][own] = np.maximum(self.suffix[order][own], grams[ORDERS[i - 1]][first])

    def block(self, i: int) -> np.ndarray:
        """Block ``i``: rows of the two classes' documents, contexts and suffixes."""
        order, at = BLOCKS[i]
        own = slice(at, at + BLOCK)
        return np.stack([*self.n[order][:, own], self.context[order][own], self.suffix[order][own]])

    def put(self, i: int, block: np.ndarray) -> None:
        order, at = BLOCKS[i]
        own = slice(at, at + BLOCK)
        self.n[order][:, own], self.context[order][own], self.suffix[order][own] = block[:2], block[2], block[3]


def packed(block: np.ndarray) -> bytes:
    return zlib.compress(block, 1)


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), np.int32).reshape(4, -1)


class Model:
    """Discounted ratios and backoff weights by bucket; ``ratio`` gives a text's log ratios by byte."""

    def __init__(self, counts: Counts, discount: float = DISCOUNT):
        self.tables = {}
        for i, order in enumerate(ORDERS):
            n = counts.n[order]
            if order != ORDERS[-1]:
                # below the top order an n-gram counts the longer ones that end in it
                longer, suffix = counts.n[ORDERS[i + 1]], counts.suffix[ORDERS[i + 1]]
                ending = lambda some: np.bincount(suffix[some & (suffix >= 0)], minlength=1 << BITS[order])
                n = [ending(longer.sum(axis=0) > 0)] if i == 0 else [ending(x > 0) for x in longer]
            self.tables[order] = [self._ratios(own, counts.context[order], 1 << BITS[order - 1], discount) for own in n]

    @staticmethod
    def _ratios(own: np.ndarray, context: np.ndarray, size: int, discount: float) -> tuple[np.ndarray, np.ndarray]:
        """Discounted shares of n-grams that ``own`` counts, and backoff weights of ``size`` contexts; in blocks, which bounds what is held beside the tables."""
        held = [np.flatnonzero((own[at : at + BLOCK] > 0) & (context[at : at + BLOCK] >= 0)) + at for at in range(0, len(own), BLOCK)]
        total, kinds = np.zeros(size), np.zeros(size)
        for some in held:
            total += np.bincount(context[some], own[some], size)
            kinds += np.bincount(context[some], minlength=size)
        half = lambda x: (HALF * np.minimum(x, 1.0)).astype(np.float16)
        keep = np.zeros(len(own), np.float16)
        for some in held:
            keep[some] = half(np.maximum(own[some] - discount, 0) / total[context[some]])
        back = np.ones(size)
        np.divide(discount * kinds, total, out=back, where=total > 0)
        return keep, half(back)

    def _step(self, grams: dict, order: int, label: int, lower) -> np.ndarray:
        keep, back = self.tables[order][label]
        scale = np.float32(1 / HALF)
        return keep.take(grams[order]) * scale + (back.take(grams[order - 1]) * scale) * lower

    def ratio(self, text: bytes) -> np.ndarray:
        grams = hashes(prepared(text))
        shared = self._step(grams, ORDERS[0], 0, np.float32(1 / 256))
        both = []
        for label in (0, 1):
            p = shared
            for order in ORDERS[1:]:
                p = self._step(grams, order, label, p)
            both.append(p)
        return np.log(both[1] / both[0])

    def features(self, text: bytes) -> list[float]:
        """Length-normalised ratios: of the text, and the largest and third largest of its windows."""
        ratio = self.ratio(text)
        run = np.concatenate([[0.0], np.cumsum(ratio, dtype=np.float64)])
        out = [run[-1] / len(ratio), np.log1p(len(ratio))]
        for width in WINDOWS:
            width = min(width, len(ratio))
            sums = (run[width:] - run[:-width]) / width
            blocks = np.full(-(-len(sums) // width) * width, -9.0)
            blocks[: len(sums)] = sums
            best = np.sort(blocks.reshape(-1, width).max(axis=1))[::-1]
            out += [best[0], best[min(2, len(best) - 1)], best[min(5, len(best) - 1)]]
        return out


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps of a ridge logistic regression; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Scorer:
    """The regression over features; without both classes it gives the smoothed rate of label 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.weights = None
        self.rate = (float(y.sum()) + 1) / (len(y) + 2)
        if 0 < y.sum() < len(y):
            self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
            self.weights = logistic(self.spread(x), y.astype(np.float64))

    def spread(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([z, z * z])

    def __call__(self, model: Model, text: bytes) -> float:
        if self.weights is None:
            return self.rate
        z = np.append(self.spread(np.array([model.features(text)]))[0], 1.0) @ self.weights
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def sample(docs: DataFrame, labels: DataFrame, toxic_rows: int, ordinary_rows: int) -> DataFrame:
    """(t, toxic, part): the labelled documents that may be learnt from, bounded by class; part 3 is for the regression."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.where(crc_remainder(4) != 2).withColumn("h", F.xxhash64("doc_id"))
    picked = [marks.where(F.col("toxic") == k).orderBy("h", "doc_id").limit(n) for k, n in ((1, toxic_rows), (0, ordinary_rows))]
    picked = written(picked[0].unionByName(picked[1]).select(F.col("doc_id").alias("_id"), "toxic"), "labelled")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("t"))
    rows = rows.join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))  # at most toxic_rows + ordinary_rows ids
    return written(rows.select("t", "toxic", crc_remainder(4).cast("int").alias("part"), F.xxhash64("doc_id").alias("h")).repartition(COUNTERS, "h"), "sample")


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> tuple[Broadcast, Scorer]:
    """Counts on two thirds of the sample and the regression on the rest; tables of fixed size reach the driver and are sent once."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = sample(docs, labels, toxic_rows, ordinary_rows)

    def count(batches):
        counts = Counts()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.add(text, label)
        for i in range(len(BLOCKS)):
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "blob": pa.array([packed(counts.block(i))], pa.binary())})

    def merge(table):
        first, *others = table["blob"]
        block = unpacked(first.as_py()).copy()
        for blob in others:
            part = unpacked(blob.as_py())
            block[:2] += part[:2]
            np.maximum(block[2:], part[2:], out=block[2:])
        return pa.table({"i": table["i"][:1], "blob": pa.array([packed(block)], pa.binary())})

    def model() -> Model:
        counts = Counts()
        parts = rows.where("part <> 3").select("t", "toxic").coalesce(COUNTERS).mapInArrow(count, "i int, blob binary")
        for row in parts.groupBy("i").applyInArrow(merge, "i int, blob binary").collect():  # a row for each of BLOCKS
            counts.put(row.i, unpacked(bytes(row.blob)))
        return Model(counts)

    held = spark.sparkContext.broadcast(model())

    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([held.value.features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    seen = rows.where("part = 3").select("t", "toxic").mapInArrow(measure, "x array<double>, y int").collect()  # a third of the sample at most
    seen.sort(key=lambda r: (r.y, r.x))
    x = np.array([r.x for r in seen], np.float64).reshape(len(seen), 2 + 3 * len(WINDOWS))
    return held, Scorer(x, np.array([r.y for r in seen], np.float64))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    Labels come from rows whose crc32 remainder is not 2; without labels of both classes every score
    is the smoothed rate. Null texts score as empty ones; null doc_ids have the remainder of the
    empty text; rows that repeat come out as often.
    """
    model, scorer = fit(docs, labels, **bounds)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([scorer(model.value, t) for t in batch.column(2).to_pylist()], pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_remainder(4) == 2).alias("held_out"), text_bytes().alias("t"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; scored where they are read, all columns stay."""
    model, scorer = fit(docs, labels, **bounds)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([scorer(model.value, (t or "").encode()) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
