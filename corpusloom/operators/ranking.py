"""Fusion, boosts, grouping, normalisation, confidence, decisions and citations as Columns and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import let


def rrf(ranked: DataFrame, qkey: str, key: str, k: int = 60) -> DataFrame:
    """(qkey, key, score): sum of 1 / (k + rank) over channels, ranks from 1."""
    return ranked.groupBy(qkey, key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def scaled(rrf_score: Column, own: Column, other_empty: Column) -> Column:
    """Thirty times the fused score, one at most; the channel's own score where the other found nothing."""
    return F.when(other_empty, own).otherwise(F.least(F.lit(1.0), 30 * rrf_score))


def coverage(terms: Column, text: Column) -> Column:
    """Share of terms that the text contains; none without terms."""
    hits = let(F.lower(text), lambda low: F.size(F.filter(terms, lambda t: F.contains(low, t))))
    return F.when(F.size(terms) > 0, hits / F.size(terms)).otherwise(0.0)


def overlap_boost(score: Column, terms: Column, text: Column, weight: float = 0.35) -> Column:
    return F.least(F.lit(1.0), score + weight * coverage(terms, text))


def title_boost(score: Column, terms: Column, title: Column, body: Column, phrases: Column) -> Column:
    """The title's coverage of the terms, with a small and a large weight, and the first phrase that the title or else the body holds."""
    cover = coverage(terms, title)
    low_title, low_body = F.lower(title), F.lower(body)
    first = F.get(F.filter(phrases, lambda p: F.contains(low_title, p) | F.contains(low_body, p)), 0)
    bonus = F.when(first.isNull(), 1.0).when(F.contains(low_title, first), 1.60).otherwise(1.25)
    return score * (1 + 0.15 * cover) * (1 + 4.0 * cover) * bonus


def controlled_title_boost(score: Column, terms: Column, title: Column, query_key: Column) -> Column:
    """1 + 0.35 coverage, and 0.25 more if the title is the query; empty titles change nothing."""
    factor = 1 + 0.35 * coverage(terms, title) + F.when(F.lower(F.trim(title)) == query_key, 0.25).otherwise(0.0)
    return F.when(F.trim(F.coalesce(title, F.lit(""))) == "", score).otherwise(score * factor)


def best_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def min_max(score: Column, *block: str) -> Column:
    """0.05 to 1 within a block; 1 where all are equal."""
    w = Window.partitionBy(*block)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi <= lo, 1.0).otherwise(0.05 + 0.95 * (score - lo) / F.when(hi > lo, hi - lo))


def page(df: DataFrame, qkey: str, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A slice of each query's rows with ``total``; the size is held between 1 and 30."""
    limit = max(1, min(30, limit))
    w = Window.partitionBy(qkey)
    df = df.withColumn("pos", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count(F.lit(1)).over(w))
    return df.where((F.col("pos") > offset) & (F.col("pos") <= offset + limit))


def confidence(top: DataFrame, qkey: str, intent: float = 0.0, llm: float = 0.0) -> DataFrame:
    """(qkey, consistency, agreement, diversity, margin, confidence) from ranked rows (rank, score, category, url)."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    five = top.where("rank <= 5")
    named = five.groupBy(qkey, "category").agg(F.count(F.lit(1)).alias("m"), F.min("rank").alias("first"))
    mode = named.groupBy(qkey).agg(F.max(F.struct("m", -F.col("first"), "category")).alias("mode"), F.sum("m").alias("n"))
    sums = five.groupBy(qkey).agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("top2"),
        F.avg("score").alias("mean5"), F.var_pop("score").alias("var5"), F.count(F.lit(1)).alias("rows"), F.count_distinct("url").alias("urls"),
    )
    df = sums.join(mode, qkey)
    df = df.withColumn("consistency", F.col("mode.m") / F.col("n")).withColumn("dominant", F.col("mode.category"))
    df = df.withColumn("agreement", F.when(F.col("rows") == 1, clamp(F.col("top1"))).otherwise(clamp(F.col("mean5") * (1 - F.least(F.lit(1.0), 4 * F.col("var5"))))))
    df = df.withColumn("diversity", F.when(F.col("urls") <= 1, 0.55).when(F.col("urls") <= 4, 0.85 + 0.05 * (F.col("urls") - 2)).otherwise(0.70))
    df = df.withColumn("margin", clamp(F.col("top1") - F.coalesce("top2", F.lit(0.0))))
    calibrated = 0.15 * intent + 0.25 * clamp(F.col("top1")) + 0.15 * clamp(F.col("mean5")) + 0.20 * F.col("consistency") + 0.15 * F.col("agreement") + 0.10 * F.col("diversity")
    legacy = 0.10 * clamp(F.col("top1")) + 0.05 * clamp(F.col("top1")) + 0.05 * 0.5
    return df.select(qkey, "dominant", "consistency", "agreement", "diversity", "margin", clamp(0.85 * calibrated + 0.15 * legacy + 0.08 * llm).alias("confidence"))


def decide(has_rows: Column, intent_confidence: Column, matches: Column, general: Column, confidence: Column, threshold: float = 0.42) -> Column:
    return (
        F.when(~has_rows, "NO_ANSWER")
        .when((intent_confidence >= 0.9) & ~matches, "RETRY_RELATED")
        .when(confidence < threshold, "NO_ANSWER")
        .when(matches | general, "ANSWER")
        .otherwise("NO_ANSWER")
    )


def business_weight(confidence: Column, category: Column, doc_type: Column, mismatch: Column, url: Column, product: Column) -> Column:
    """Product of the factors that apply, each scaled by the confidence, held between 0.55 and 1.55."""
    scale = F.greatest(F.lit(0.35), F.least(F.lit(1.0), confidence))
    factor = lambda on, weight: F.when(on, 1 + (weight - 1) * scale).otherwise(1.0)
    weight = factor(category, 1.22) * factor(doc_type, 1.18) * factor(mismatch, 0.72) * factor(url, 1.28) * factor(product, 1.12)
    return F.when(confidence <= 0, 1.0).otherwise(F.greatest(F.lit(0.55), F.least(F.lit(1.55), weight)))


def staged(counts: DataFrame, required: Column, qkey: str) -> DataFrame:
    """Of tagged filter stages (stage, n) the first that has enough rows, else the last."""
    order = Window.partitionBy(qkey).orderBy(F.desc((F.col("n") >= required).cast("int")), F.when(F.col("n") >= required, F.col("stage")).otherwise(-F.col("stage")))
    return counts.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def within_budget(df: DataFrame, qkey: str, order: list[Column], tokens: Column, budget: int = 2000) -> DataFrame:
    """Rows before the first that would exceed the budget, with ``used``."""
    w = Window.partitionBy(qkey).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)


def citations(df: DataFrame, qkey: str, floor: float = 0.45, near: float = 0.12, most: int = 3) -> DataFrame:
    """The best distinct URLs near the top score: (rank, score, url, category), with a bonus for the dominant category."""
    w = Window.partitionBy(qkey)
    df = df.withColumn("top", F.max("score").over(w)).where((F.col("score") >= floor) & (F.col("top") - F.col("score") <= near))
    df = best_per(df, [qkey, "url"], F.col("rank"))
    df = df.withColumn("place", F.row_number().over(w.orderBy("rank"))).where(F.col("place") <= most)
    return df


def metrics(ranked: DataFrame, qkey: str, k: int = 5) -> DataFrame:
    """(qkey, hit, mrr, ndcg, top1, top3) from rows (rank, label); the ideal order is of the retrieved labels."""
    w = Window.partitionBy(qkey).orderBy(F.desc("label"), "rank")
    df = ranked.withColumn("ideal", F.row_number().over(w))
    gain = lambda at: F.sum(F.when(F.col(at) <= k, F.col("label") / F.log2(F.col(at) + 1.0)).otherwise(0.0))
    first = F.min(F.when(F.col("label") > 0, F.col("rank")))
    out = df.groupBy(qkey).agg(first.alias("first"), gain("rank").alias("dcg"), gain("ideal").alias("best"))
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return out.select(qkey, flag(F.col("first") <= k).alias("hit"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), F.when(F.col("best") > 0, F.col("dcg") / F.when(F.col("best") > 0, F.col("best"))).otherwise(0.0).alias("ndcg"), flag(F.col("first") == 1).alias("top1"), flag(F.col("first") <= 3).alias("top3"))


def layered(critical: Column, semantic: Column, semantic_score: Column, rule: Column, default: str, high: float = 0.90, low: float = 0.60, accept: float = 0.58) -> Column:
    """The label of the first layer that is sure: critical rules, a sure semantic label, a rule, a fair semantic label."""
    return (
        F.when(critical.isNotNull(), critical)
        .when(semantic_score >= high, semantic)
        .when((semantic_score >= low) & rule.isNotNull(), rule)
        .when(semantic_score >= low, semantic)
        .when(rule.isNotNull(), rule)
        .when(semantic_score >= accept, semantic)
        .otherwise(default)
    )


def by_priority(df: DataFrame, qkey: str, priority: Column, moved: Column | None = None) -> DataFrame:
    """Rows by priority, then score, then rank, the moved ones (a named product) first; adds ``place``."""
    first = F.lit(0) if moved is None else F.when(moved, 0).otherwise(1)
    w = Window.partitionBy(qkey).orderBy(first, F.desc(priority), F.desc("score"), "rank")
    return df.withColumn("place", F.row_number().over(w))


def metadata_rank(score: Column, page_match: Column, navigation: Column, category_match: Column, topic_match: Column) -> Column:
    add = lambda on, v: F.when(on, v).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score + add(page_match, 0.08) - add(navigation, 0.12) + add(category_match, 0.05) + add(topic_match, 0.06)))


def additive_boost(score: Column, *parts: tuple[Column, float]) -> Column:
    """Score plus the weights of the conditions that hold, held between 0 and 1."""
    total = score
    for on, weight in parts:
        total = total + F.when(on, weight).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def exact_titles(queries: DataFrame, pages: DataFrame, score: float = 10_000.0) -> DataFrame:
    """(query_id, page, score): for each query (query_id, query) the smallest page (page, title) whose title it is, whatever the case."""
    key = lambda c: F.lower(F.trim(F.col(c)))
    owners = pages.groupBy(key("title").alias("key")).agg(F.min("page").alias("page"))
    return queries.select("query_id", key("query").alias("key")).join(owners, "key").select("query_id", "page", F.lit(score).alias("score"))


def legacy_confidence(rank: str, score: str, overlap: str) -> Column:
    """An aggregate: 0.55 of the mean of the first three scores and 0.45 of the largest overlap of the first five."""
    return 0.55 * F.avg(F.when(F.col(rank) <= 3, F.col(score))) + 0.45 * F.max(F.when(F.col(rank) <= 5, F.col(overlap)))


def citation_key(score: Column, phrase: Column, body: Column, title: Column, category: Column) -> list[Column]:
    """Sort order of citations: score in steps of 0.02 (halves to even), phrase, body coverage, title likeness, a category."""
    return [F.desc(F.bround(score / 0.02, 0)), F.desc(phrase), F.desc(body), F.desc(title), F.desc(category)]


def citation_pool(rows: DataFrame, qkey: str, place: str, score: str, key: str, k: int, *order: Column) -> DataFrame:
    """The best row of each place, then the best ``k`` of each query, with ``rank``."""
    sort = [F.desc(score), *order, F.col(key)]
    own = best_per(rows, [qkey, place], *sort)
    return own.withColumn("rank", F.row_number().over(Window.partitionBy(qkey).orderBy(*sort))).where(F.col("rank") <= k)
