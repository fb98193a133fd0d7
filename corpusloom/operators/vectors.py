"""A store of vectors and exact search in it by blocks.

Queries are taken in blocks of a bounded size; a block is sent to all tasks, each task holds its rows
against it in batches by one matrix product and keeps the best ``k`` of each query, and these partial
lists meet per query. A pass over the rows costs one block, nothing is nested and nothing that is sent
grows with the data. Scores are rounded before they are compared, so ties go to the smaller key
wherever the rows lie.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.operators.corpus import changed
from corpusloom.sources.storage import written

#: Queries of a block, and numbers (of eight bytes) that a block's vectors may have.
BLOCK, BLOCK_NUMBERS = 1024, 1 << 21
#: Rows that are multiplied at once.
ROWS = 2048


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in double, their places): vectors that are null, zero, not finite or of another length than most take no part."""
    size = pa.compute.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    usable = size[size > 0]
    if not len(usable):
        return np.empty((0, 0)), np.empty(0, np.int64)
    places = np.flatnonzero(size == np.bincount(usable).argmax())
    flat = column.take(pa.array(places)).flatten().cast(pa.float64())
    rows = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(places), -1)
    norm = np.sqrt((rows * rows).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return rows[good] / norm[good, None], places[good]


def query_blocks(queries: DataFrame, key: str, vector: str, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, unit vectors) block by block; the driver holds one block and one partition of the keyed vectors."""
    keys, rows = [], []

    def made():
        found, places = matrix(pa.array(rows, pa.list_(pa.float64())))
        return np.array(keys, np.int64)[places], found

    for row in queries.where(F.col(key).isNotNull()).select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).toLocalIterator():
        keys.append(row[0])
        rows.append(row[1])
        if len(keys) >= block or len(keys) * max(1, len(row[1] or ())) >= BLOCK_NUMBERS:
            yield made()
            keys, rows = [], []
    if keys:
        yield made()


def best_rows(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of each row of ``scores`` by score, then smaller key; -inf is never one."""
    order = np.lexsort((np.broadcast_to(keys, scores.shape), -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), keys[order]


def _scan(rows: DataFrame, key: str, vector: str, block, places: int, least: float, more: list[str], start: Callable, ddl: str) -> DataFrame:
    """``start`` makes a task's (add, out): ``add`` takes (scores, keys, batch, places) of some rows, ``out`` yields Arrow batches."""
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        ids, vectors = sent.value
        add, out = start(ids)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                found, where = matrix(batch.column(1))
                if not len(where) or not len(ids) or found.shape[1] != vectors.shape[1]:
                    continue
                keys = batch.column(0).to_numpy(zero_copy_only=False)[where].astype(np.int64)
                scores = np.round(np.maximum(vectors @ found.T, 0.0), places)
                scores[(ids[:, None] == keys[None, :]) | (scores < least)] = -np.inf
                add(scores, keys, batch, where)
        yield from out()

    return rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_key"), F.col(vector).cast("array<double>").alias("_vector"), *more).mapInArrow(run, ddl)


def nearest(queries: DataFrame, rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", places: int = 6, least: float = 0.0, block: int = BLOCK, qkey: str | None = None) -> DataFrame:
    """(query_id, key, score, rank): the ``k`` rows of largest cosine (negative ones count as 0) of each query but itself, at least ``least``.

    With ``qkey`` the queries have keys of another kind, and no row is a query's own.
    """

    def start(ids):
        kept = [np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int64)]

        def add(scores, keys, batch, where):
            new, ks = best_rows(scores, keys, k)
            both, ks = np.concatenate([kept[0], new], axis=1), np.concatenate([kept[1], ks], axis=1)
            order = np.lexsort((ks, -both), axis=1)[:, :k]
            kept[0], kept[1] = np.take_along_axis(both, order, 1), np.take_along_axis(ks, order, 1)

        def out():
            score, ks = kept
            query = np.repeat(ids, score.shape[1]) if qkey is None else np.repeat(-ids - 1, score.shape[1])
            real = np.isfinite(score.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(x[real]) for x in (query, ks.ravel(), score.ravel())], ["query_id", "key", "score"])

        return add, out

    found = None
    for ids, vectors in query_blocks(queries, qkey or key, vector, block):
        # keys of another kind are told apart by their sign
        part = written(_scan(rows, key, vector, (ids if qkey is None else -ids - 1, vectors), places, least, [], start, "query_id long, key long, score double"), "nearest")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "query_id long, key long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("key").alias(key), "score", "rank")


def nearest_labels(queries: DataFrame, rows: DataFrame, label: str = "label", key: str = "vec_id", vector: str = "embedding", places: int = 6, least: float = 0.0, block: int = BLOCK) -> DataFrame:
    """(query_id, label, score): the largest cosine of each query to the rows of each label, at least ``least``, itself left out."""

    kind = to_arrow_type(rows.schema[label].dataType)

    def start(ids):
        best: dict = {}

        def add(scores, keys, batch, where):
            names = np.array(batch.column(2).to_pylist(), object)[where]
            for name in set(names.tolist()):
                most = scores[:, names == name].max(axis=1)
                best[name] = np.maximum(best[name], most) if name in best else most

        def out():
            for name, score in best.items():
                real = np.isfinite(score)
                yield pa.RecordBatch.from_arrays([pa.array(ids[real]), pa.array([name] * int(real.sum()), kind), pa.array(score[real])], ["query_id", "label", "score"])

        return add, out

    found, ddl = None, f"query_id long, label {rows.schema[label].dataType.simpleString()}, score double"
    for part in query_blocks(queries, key, vector, block):
        part = written(_scan(rows, key, vector, part, places, least, [F.col(label).alias("_label")], start, ddl), "labels")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], ddl)
    return found.groupBy("query_id", "label").agg(F.max("score").alias("score"))


@functools.lru_cache(maxsize=1 << 16)
def _place(token: str, size: int) -> int:
    import hashlib

    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % size


def hash_embedding(size: int = 64) -> Callable:
    """A stand-in for a model: token counts by hash. Such a function takes token lists and returns a matrix."""

    def embed(lists: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(lists), size))
        for row, tokens in zip(out, lists):
            row += np.bincount(np.fromiter((_place(t, size) for t in tokens), np.int64, len(tokens)), minlength=size)
        return out

    return embed


def embedded(rows: DataFrame, key: str, tokens, model: Callable | None = None, batch: int = 256) -> DataFrame:
    """(key, embedding) of ``rows``: ``model`` runs once a task over batches of token lists; null lists are empty ones."""
    model = model or hash_embedding()

    def run(batches):
        for got in batches:
            for at in range(0, got.num_rows, batch):
                part = got.slice(at, batch)
                vectors = model([x or [] for x in part.column(1).to_pylist()])
                flat = pa.array(vectors.astype(np.float64).ravel())
                ends = pa.array(np.arange(0, vectors.size + 1, vectors.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, flat)], [key, "embedding"])

    return rows.select(F.col(key).cast("long").alias(key), tokens.alias("_tokens")).mapInArrow(run, f"{key} long, embedding array<double>")


def embedded_counts(rows: DataFrame, key: str, counts: str = "c", size: int = 64) -> DataFrame:
    """(key, embedding) as ``hash_embedding`` gives them, of ``rows`` with counted terms, an array of (term, tf): each term of a batch is placed once."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                many = pa.compute.list_value_length(part.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
                flat = part.column(1).flatten()
                terms = flat.field(0).dictionary_encode()
                places = np.array([_place(t, size) for t in terms.dictionary.to_pylist()], np.int64)
                cell = np.repeat(np.arange(len(many)), many) * size + places[terms.indices.to_numpy(zero_copy_only=False)]
                vectors = np.bincount(cell, flat.field(1).to_numpy(zero_copy_only=False), len(many) * size)
                ends = pa.array(np.arange(0, len(vectors) + 1, size, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(vectors, pa.float64()))], [key, "embedding"])

    return rows.select(F.col(key).cast("long").alias(key), counts).mapInArrow(run, f"{key} long, embedding array<double>")


def refreshed(store: DataFrame | None, rows: DataFrame, key: str, text: str, tokens, model: Callable | None = None) -> DataFrame:
    """(key, hash, embedding): the store after an ingest of ``rows``: only rows whose text's hash changed are embedded again, rows that are gone go."""
    new = rows.select(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("hash"), tokens.alias("_tokens"))
    if store is None:
        return embedded(new, key, F.col("_tokens"), model).join(new.select(key, "hash"), key).select(key, "hash", "embedding")
    fresh = changed(new, store.select(key, "hash"), key, "hash")
    made = embedded(fresh, key, F.col("_tokens"), model).join(fresh.select(key, "hash"), key)
    return store.join(new.select(key, "hash"), [key, "hash"], "left_semi").select(key, "hash", "embedding").unionByName(made.select(key, "hash", "embedding"))
