"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The mix is cut into blocks of equal word counts. Blocks go to sources by highest quotients of their
targets, then to a source's shards by highest quotients of the shards' sizes; shards hold a bounded
number of words, so a hot source has many. Within a shard the documents follow each other in a
seeded order and the shard takes its quota as a run of blocks from a seeded start, round and round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BLOCK_WORDS, SHARD_WORDS, SEED = 16, 1 << 20, "mix"


def apportion(votes: DataFrame, group: list[str], order: list[str], seats: str = "seats") -> DataFrame:
    """Highest quotients votes / (2 s + 1) within each group; adds ``quota`` to (group, order, votes, seats).

    All but a few seats follow in closed form: rounding the exact share can be off by no more than one
    and the party's share of the group's parties, so it starts that far below and only the rest is
    ranked. Ties go by ``order``. A group of no votes gets no seats.
    """
    whole = Window.partitionBy(*group)
    share = F.col("votes") / F.col("_all")
    df = votes.withColumn("_all", F.sum("votes").over(whole)).withColumn("_n", F.count(F.lit(1)).over(whole))
    below = F.floor(F.col(seats) * share + 0.5) - 1 - F.ceil(F.col("_n") * share)
    df = df.withColumn("_low", F.when(F.col("_all") > 0, F.greatest(F.lit(0).cast("long"), below.cast("long"))).otherwise(F.lit(0).cast("long")))
    df = df.withColumn("_rest", F.when(F.col("_all") > 0, F.col(seats) - F.sum("_low").over(whole)).otherwise(F.lit(0).cast("long")))
    tries = F.when(F.col("votes") > 0, F.ceil((F.col("_rest") + F.col("_n")) * share) + 1).otherwise(F.lit(0)).cast("int")
    asked = df.withColumn("_k", F.explode(F.sequence(F.lit(0), tries)))
    asked = asked.withColumn("_q", F.col("votes") / (2 * (F.col("_low") + F.col("_k")) + 1))
    best = Window.partitionBy(*group).orderBy(F.desc("_q"), *[F.col(c).asc_nulls_last() for c in order])
    asked = asked.withColumn("_won", ((F.row_number().over(best) <= F.col("_rest")) & (F.col("votes") > 0)).cast("long"))
    keys = list(dict.fromkeys([*group, *order]))
    rest = [c for c in votes.columns if c not in keys]
    return asked.groupBy(*keys).agg(*[F.first(c).alias(c) for c in rest], (F.first("_low") + F.sum("_won")).alias("quota"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target): shares by weight, held at ``most`` times a source's size.

    The one-partition windows run over one row per source.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    named = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    src = src.withColumn("_i", F.row_number().over(named) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod("_i", F.lit(len(weights))).cast("int") + 1).cast("long")
    src = src.withColumn("weight", weight).withColumn("_cap", most * F.col("source_size")).withColumn("_full", F.col("_cap") / F.col("weight"))
    fill = Window.partitionBy(F.lit(0)).orderBy("_full", "_i").rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(fill), F.lit(0.0))
    open_ = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(fill), F.lit(0).cast("long"))
    src = src.withColumn("_left", left).withColumn("_open", open_).withColumn("_held", F.col("_full") <= F.col("_left") / F.col("_open"))
    first = F.min(F.when(~F.col("_held"), F.struct("_full", "_i", "_left", "_open"))).over(every)
    src = src.withColumn("_f", first)
    free = F.col("weight") * F.col("_f._left") / F.col("_f._open")
    above = F.col("_f").isNull() | (F.struct("_full", "_i") < F.struct(F.col("_f._full"), F.col("_f._i")))
    return src.select("source", "source_size", "weight", F.when(above, F.col("_cap")).otherwise(free).cast("double").alias("target"))


def number(text):
    """A non-negative whole number of 60 bits from the MD5 of ``text``."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK_WORDS, shard: int = SHARD_WORDS, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs`` (doc_id, text, source).

    A null text has size 0; a null source is a source of its own, the last one; a null doc_id hashes
    as an empty one. Repeated rows take part one by one. Documents without words are never taken.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    sizes = written(sizes, "sizes")
    src = written(targets(sizes, weights, share, most), "targets")
    # Sainte-Lague over sources: as many blocks as all targets hold
    votes = src.select(F.lit(0).alias("g"), "source", "source_size", "target", F.col("target").alias("votes"))
    votes = votes.withColumn("seats", F.floor(F.sum("target").over(Window.partitionBy("g")) / block + 0.5).cast("long"))
    won = apportion(votes, ["g"], ["source"]).select("source", "source_size", "target", F.col("quota").alias("blocks"))
    won = written(won.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard)).cast("long")), "quotas")

    ident = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    won_ = won.withColumnRenamed("source", "_source")
    dealt = sizes.join(won_, sizes["source"].eqNullSafe(won_["_source"])).drop("_source")
    dealt = dealt.withColumn("shard", F.when(F.col("size") > 0, F.pmod(number(ident), F.col("shards"))))
    # quotas of shards
    held = dealt.where("size > 0").groupBy("source", "shard").agg(F.sum("size").alias("votes"), F.first("blocks").alias("seats"))
    quota = apportion(held, ["source"], ["shard"])
    quota = quota.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), F.col("votes").alias("held"), F.least(F.col("quota") * block, (most * F.col("votes")).cast("long")).alias("words"))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col("_source")), F.lit("")), F.lit(":"), F.col("_shard").cast("string"))
    quota = quota.withColumn("begin", F.pmod(number(name), F.ceil(F.col("held") / block).cast("long")) * block)
    quota = quota.withColumn("rounds", F.floor(F.col("words") / F.col("held")).cast("long")).withColumn("rest", F.col("words") - F.col("rounds") * F.col("held"))

    run = Window.partitionBy("source", "shard").orderBy(F.md5(ident), F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = dealt.where("size > 0").withColumn("stop", F.sum("size").over(run)).withColumn("start", F.col("stop") - F.col("size"))
    laid = laid.join(quota, laid["source"].eqNullSafe(quota["_source"]) & (laid["shard"] == quota["_shard"]))
    zero = F.lit(0).cast("long")
    end = F.col("begin") + F.col("rest")
    first = F.greatest(zero, F.least("stop", end) - F.greatest("start", "begin"))
    again = F.greatest(zero, F.least(F.col("stop"), end - F.col("held")) - F.col("start"))
    taken = laid.select("doc_id", "size", "source_size", "target", (F.col("rounds") * F.col("size") + first + again).alias("taken"))
    none = dealt.where("size = 0").select("doc_id", "size", "source_size", "target", zero.alias("taken"))
    return taken.unionByName(none)
