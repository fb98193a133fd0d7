"""Dense and sparse vector scoring, exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def nearest(queries: DataFrame, base: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score, rank): cosine of a stated query set against all rows, at least 0.

    The queries are the broadcast side: the caller passes a set of a known size.
    """
    q = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("qv"))
    met = base.select(key, vector).join(F.broadcast(q), F.col("query_id") != F.col(key))
    met = met.select("query_id", key, F.greatest(F.lit(0.0), cosine(F.col(vector), F.col("qv"))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), key)
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hybrid(dense: Column, sparse_dot: Column, text_hits: Column, alpha: float = 0.7) -> Column:
    """alpha dense + the rest sparse; without document weights text hits stand in, without query weights dense alone."""
    rest = F.lit(1 - alpha)
    return (
        F.when(sparse_dot.isNotNull(), alpha * dense + rest * F.least(F.lit(1.0), sparse_dot))
        .when(text_hits.isNotNull(), alpha * dense + rest * F.least(F.lit(1.0), text_hits / 5))
        .otherwise(dense)
    )


def top_weights(weights: Column, k: int = 64) -> Column:
    """The ``k`` largest entries of a map, by weight, then key, rounded to five digits."""
    entries = F.array_sort(F.transform(F.map_entries(weights), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k"))))
    return F.map_from_entries(F.transform(F.slice(entries, 1, k), lambda e: F.struct(e["k"], F.round(-e["n"], 5))))


def sparse_dot(a: Column, b: Column) -> Column:
    """Sum of products over common keys of two maps."""
    return F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + F.element_at(a, k) * F.coalesce(F.try_element_at(b, k), F.lit(0.0)))


def nearest_label(scored: DataFrame, qkey: str = "query_id", label: str = "label", least: float = 0.58, margin: float = 0.05) -> DataFrame:
    """(qkey, label, score, margin, accepted): best score per label, the winner and its lead over the runner-up."""
    best = scored.groupBy(qkey, label).agg(F.max("score").alias("score"))
    order = Window.partitionBy(qkey).orderBy(F.desc(F.round("score", 6)), label)
    best = best.withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("score").over(order))
    best = best.where("rank = 1").withColumn("margin", F.col("score") - F.coalesce("next", F.lit(0.0)))
    return best.select(qkey, label, "score", "margin", ((F.col("score") >= least) & (F.col("margin") >= margin)).alias("accepted"))
