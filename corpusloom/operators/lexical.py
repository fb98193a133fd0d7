"""BM25 over postings: many queries in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def term_statistics(docs: DataFrame, tokens: Column) -> DataFrame:
    """(term, df, total): documents by term; the row of the null term counts all documents and, as ``total``, their tokens.

    Each document names a term once and the null term at its end, so one aggregate, combined in the
    scan tasks, gives all the statistics. Null texts are empty ones.
    """
    rows = docs.select(F.coalesce(tokens, F.array().cast("array<string>")).alias("ts"))
    rows = rows.select(F.size("ts").alias("dl"), F.array_append(F.array_distinct("ts"), F.lit(None).cast("string")).alias("ts"))
    rows = rows.select("dl", F.explode_outer("ts").alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("total"))


def idf_table(statistics: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """(term, df, idf): Okapi; a negative idf gives way to ``epsilon`` times the mean one."""
    # told apart by the sum and not by the term, so that all readers share one exchange
    n = statistics.where("total is not null").select(F.col("df").alias("n"))  # one row
    df = statistics.where("total is null").join(F.broadcast(n), how="cross").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.agg(F.avg("raw").alias("mean"))  # one row
    return df.join(F.broadcast(mean), how="cross").select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def term_counts(docs: DataFrame, key: str, tokens: Column, wanted: DataFrame | None = None) -> DataFrame:
    """(key, term, tf, dl): postings, of the ``wanted`` terms only if given; others leave before the shuffle where those are few enough to be sent."""
    rows = docs.select(key, tokens.alias("ts")).select(key, F.size("ts").alias("dl"), F.explode_outer("ts").alias("term")).where("term is not null")
    if wanted is not None:
        rows = rows.join(wanted, "term", "left_semi")
    return rows.groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame, qkey: str) -> DataFrame:
    """(qkey, term, qtf) of the queries' texts."""
    return queries.select(qkey, F.explode_outer(T.tokenize(F.col("text"))).alias("term")).where("term is not null").groupBy(qkey, "term").agg(F.count(F.lit(1)).alias("qtf"))


def bm25_over(terms: DataFrame, postings: DataFrame, statistics: DataFrame, key: str, qkey: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(qkey, key, score) from query terms, postings and statistics, computed or stored."""
    asked = terms.join(idf_table(statistics, epsilon).select("term", "idf"), "term")
    mean = statistics.where("total is not null").select((F.col("total") / F.col("df")).alias("avgdl"))  # one row
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    met = postings.join(F.broadcast(mean), how="cross").join(asked, "term").withColumn("part", F.col("qtf") * F.col("idf") * weight)
    return met.groupBy(qkey, key).agg(F.sum("part").alias("score")).where("score > 0")


def bm25(queries: DataFrame, docs: DataFrame, key: str = "doc_id", qkey: str = "item_id", text: Column | None = None, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(qkey, key, score) of every pair that shares a term; a term that a query repeats counts again.

    Only postings of the queries' terms are made; document frequencies cover every term.
    """
    tokens = T.tokenize(F.col("text") if text is None else text)
    terms = query_terms(queries, qkey)
    return bm25_over(terms, term_counts(docs, key, tokens, terms.select("term").distinct()), term_statistics(docs, tokens), key, qkey, k1, b, epsilon)


def top_k(scored: DataFrame, qkey: str, key: str, k: int, score: str = "score") -> DataFrame:
    """The best ``k`` of each query with ``rank`` from 1; ties to the smaller key."""
    order = Window.partitionBy(qkey).orderBy(F.desc(score), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
