"""Completion from an index of prefixes: a bounded list of titles for each beginning of a title or of one of its words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.sources.storage import written

LONGEST, KEEP = 12, 8


def plain(text: Column) -> Column:
    return F.lower(T.squash(F.coalesce(text, F.lit(""))))


def index(titles: DataFrame, title: str, longest: int = LONGEST, keep: int = KEEP, wanted: DataFrame | None = None) -> DataFrame:
    """(prefix, title, score, weight, rank): the ``keep`` best titles of each prefix of up to ``longest`` characters, of the ``wanted`` (prefix) only if given.

    A title that begins with the prefix scores 1, one with a word that begins with it 0.82; ties go to
    the title that more rows have, then to the smaller one. Titles are numbered in their order, so a
    beginning travels with a number and not with the title, each task hands on ``keep`` numbers of a
    prefix, and titles come back to the best ones only.
    """
    rows = titles.select(plain(F.col(title)).alias("title")).where("title <> ''").groupBy("title").agg(F.count(F.lit(1)).alias("weight"))
    parts = max(2, int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    numbered = written(rows.repartitionByRange(parts, "title").sortWithinPartitions("title").withColumn("at", F.monotonically_increasing_id()), "titles")
    # so many characters span as many words at most, so a beginning needs a few words and not the whole title
    heads = f"transform(array(split(title, ' ')), w -> array_distinct(transform(sequence(1, size(w)), i -> substring(array_join(slice(w, i, {longest}), ' '), 1, {longest}))))[0]"
    begun = F.expr(f"array_distinct(flatten(transform({heads}, h -> transform(sequence(1, length(h)), n -> substring(h, 1, n)))))")
    rows = numbered.select("at", "weight", F.substring("title", 1, longest).alias("start"), F.explode(begun).alias("prefix")).where("not endswith(prefix, ' ')")
    rows = rows if wanted is None else rows.join(wanted.select("prefix").distinct(), "prefix", "left_semi")
    rows = rows.select("prefix", "at", "weight", F.when(F.startswith("start", "prefix"), 1.0).otherwise(0.82).alias("score"))
    order = Window.partitionBy("prefix").orderBy(F.desc("score"), F.desc("weight"), "at")
    best = written(rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep), "best")
    return best.join(numbered.select("at", "title"), "at").select("prefix", "title", "score", "weight", "rank")


def asked(queries: DataFrame, text: str, longest: int = LONGEST) -> DataFrame:
    """(prefix): what users have typed on the way to each query, each once."""
    rows = queries.select(plain(F.col(text)).alias("t")).where("t <> ''").select(F.explode(F.expr(f"transform(sequence(1, least({longest}, length(t))), n -> substring(t, 1, n))")).alias("prefix"))
    return rows.where("not endswith(prefix, ' ')").distinct()


def complete(found: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, title, score, rank) of the given prefixes."""
    return found.join(prefixes, "prefix").select("prefix", "title", "score", "rank")
