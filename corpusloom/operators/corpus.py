"""Corpus operators: boilerplate, duplicates, merges, snapshots, rules, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.sources.storage import written

#: Keys that are sent to every task at most; more of them are shuffled.
SENT = 1_000_000


def boilerplate(pages: DataFrame, lines: Column, group: str, key: str, fraction: float = 0.55, least: int = 40, shortest: int = 2, longest: int = 180) -> DataFrame:
    """(group, line, pages): lines on at least max(least, fraction of the group's pages) pages.

    Distinct (page, line) is an aggregate before the count, so repeats within a page cost nothing twice.
    """
    low = F.transform(lines, lambda x: F.lower(F.trim(x)))
    rows = pages.select(group, key, F.explode_outer(F.array_distinct(F.filter(low, lambda x: (F.length(x) >= shortest) & (F.length(x) <= longest)))).alias("line")).where("line is not null")
    sizes = pages.groupBy(group).agg(F.greatest(F.lit(least), F.floor(F.count_distinct(key) * fraction)).alias("least"))
    counts = rows.groupBy(group, "line").agg(F.count_distinct(key).alias("pages"))
    return counts.join(F.broadcast(sizes), group).where(F.col("pages") >= F.col("least")).select(group, "line", "pages")


def first_owner(docs: DataFrame, group: list[str], key: str) -> DataFrame:
    """Adds ``duplicate_of``: the smallest key of the group, null for that row itself.

    The owner is an aggregate joined back, so a hot group never sits in one window task.
    """
    owner = docs.groupBy(*group).agg(F.min(key).alias("_owner"))
    names = [c for c in docs.columns]
    out = docs.join(owner.select(*[F.col(c).alias(f"_{c}") for c in group], "_owner"), [docs[c].eqNullSafe(F.col(f"_{c}")) for c in group], "left")
    return out.select(*names, F.when(F.col("_owner") < F.col(key), F.col("_owner")).alias("duplicate_of"))


def keyed_override(base: DataFrame, *overrides: DataFrame, key: str, order: str) -> DataFrame:
    """Union in which later sources win a key, and of one source the last row."""
    tagged = [df.withColumn("_p", F.lit(i)) for i, df in enumerate((base, *overrides))]
    every = tagged[0]
    for df in tagged[1:]:
        every = every.unionByName(df)
    w = Window.partitionBy(key).orderBy(F.desc("_p"), F.desc(order))
    return every.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_p")


def changed(new: DataFrame, old: DataFrame, key: str, hash_: str) -> DataFrame:
    """Rows of ``new`` whose hash is not the stored one."""
    stored = old.select(F.col(key).alias("_key"), F.col(hash_).alias("_hash"))
    return new.join(stored, new[key] == F.col("_key"), "left").where(~F.col(hash_).eqNullSafe(F.col("_hash"))).drop("_key", "_hash")


def stale(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` whose key is gone."""
    return old.join(new.select(key), key, "left_anti")


def first_match(rows: DataFrame, rules: list[tuple[str, str]], text: Column, default: str) -> Column:
    """Label of the first rule (pattern, label) that the text matches; a chain of literals, not a join."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out


def rule_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    """(priority, pattern, label, confidence) of (pattern, label, confidence) rows in their order."""
    rows = [F.struct(F.lit(i).alias("priority"), F.lit(p).alias("pattern"), F.lit(n).alias("label"), F.lit(float(c)).alias("confidence")) for i, (p, n, c) in enumerate(rules)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def classify(queries: DataFrame, rules: DataFrame, qkey: str, text: str, default: str) -> DataFrame:
    """(qkey, label, confidence) of the first rule whose pattern the text matches; the rules are the broadcast side."""
    met = queries.select(qkey, text).join(F.broadcast(rules), F.expr(f"{text} rlike pattern"), "left")
    best = met.groupBy(qkey).agg(F.min(F.when(F.col("label").isNotNull(), F.struct("priority", "label", "confidence"))).alias("b"))
    return best.select(qkey, F.coalesce("b.label", F.lit(default)).alias("label"), F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"))


def menu_heavy(text: Column, markers: tuple[str, ...] = ("Welcome |", "Main Menu"), goods: tuple[str, ...] = ("Certificates", "Accounts", "Cards", "Loans")) -> Column:
    """Text that is mostly a menu: furniture at its head, product soup, or many separators."""
    head = F.substring(text, 1, 180)
    marked = F.lit(False)
    for m in markers:
        marked = marked | head.contains(m)
    product = sum((text.contains(g).cast("int") for g in goods), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    linked = F.size(F.filter(lines, lambda x: (F.length(x) < 80) & x.contains(" - ")))
    soup = (product >= 4) & (F.length(text) > 800) & (F.regexp_count(text, F.lit("\n")) < 5)
    many = (F.regexp_count(text, F.lit(" - ")) >= 12) | (F.regexp_count(text, F.lit(r" \| ")) >= 8) | ((F.size(lines) > 30) & (linked / F.greatest(F.lit(1), F.size(lines)) > 0.6))
    return F.when(F.length(text) < 200, F.lit(False)).otherwise(marked | soup | many)


def quality_penalty(text: Column) -> Column:
    """0.4 for empty text, else what menus, pipes and shortness add up to, 0.4 at most."""
    pipes = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    parts = F.when(menu_heavy(text), 0.25).otherwise(0.0) + F.when(pipes >= 6, 0.1).otherwise(0.0) + F.when(F.length(text) < 120, 0.1).otherwise(0.0)
    return F.when(F.trim(text) == "", 0.4).otherwise(F.least(F.lit(0.4), parts))


def language_of(text: Column) -> Column:
    """Arabic where enough letters are, else English."""
    arabic = F.regexp_count(text, F.lit("[؀-ۿ]"))
    return F.when(arabic >= F.greatest(F.lit(3), F.floor(F.length(text) / 8)), "ar").otherwise("en")


def chunks(docs: DataFrame, key: str, text: Column, max_tokens: int = 280, overlap: int = 50, parent_tokens: int = 800) -> DataFrame:
    """(key, section_no, heading, level, chunk_index, parent_index, text): parents of sections and children of paragraphs.

    Sections start at '## ' lines; tables are atomic and come before a section's other paragraphs; a
    parent keeps its first window; children carry their heading; one counter numbers both levels.
    """
    parts = F.split(F.concat(F.lit("\n"), text), r"\n(?=## )")
    rows = docs.select(key, F.posexplode_outer(parts).alias("section_no", "raw"))
    head = F.regexp_extract("raw", r"^\s*## ([^\n]*)", 1)
    rows = rows.select(key, "section_no", F.trim(head).alias("heading"), F.trim(F.regexp_replace("raw", r"^\s*## [^\n]*\n?", "")).alias("body")).where("heading <> '' or body <> ''")
    tables = F.regexp_extract_all("body", F.lit(r"(?s)\[TABLE\].*?\[/TABLE\]"), F.lit(0))
    rest = F.filter(F.split(F.regexp_replace("body", r"(?s)\[TABLE\].*?\[/TABLE\]", ""), r"\n\s*\n"), lambda p: F.trim(p) != "")
    rows = rows.withColumn("paragraphs", F.concat(tables, F.transform(rest, lambda p: F.trim(p))))
    titled = lambda c: F.when(F.col("heading") != "", F.concat(F.lit("## "), F.col("heading"), F.lit("\n"), c)).otherwise(c)
    parent = rows.select(key, "section_no", "heading", F.lit(0).alias("level_no"), F.lit(0).alias("p"), F.lit(0).alias("w"), F.get(T.word_windows(titled(F.col("body")), parent_tokens, 0), 0).alias("text"))
    child = rows.select(key, "section_no", "heading", F.posexplode_outer("paragraphs").alias("p", "para")).where("para is not null")
    child = child.select(key, "section_no", "heading", F.lit(1).alias("level_no"), "p", F.posexplode_outer(T.word_windows(titled(F.col("para")), max_tokens, overlap)).alias("w", "text"))
    every = parent.unionByName(child)
    order = Window.partitionBy(key).orderBy("section_no", "level_no", "p", "w")
    every = every.withColumn("chunk_index", F.row_number().over(order) - 1)
    above = F.max(F.when(F.col("level_no") == 0, F.col("chunk_index"))).over(Window.partitionBy(key, "section_no"))
    return every.select(key, "section_no", "heading", F.when(F.col("level_no") == 0, "parent").otherwise("child").alias("level"), "chunk_index", F.when(F.col("level_no") == 1, above).alias("parent_index"), "text")


def indexable(found: DataFrame, key: str) -> DataFrame:
    """Children where a document has any, else everything."""
    some = F.max((F.col("level") == "child").cast("int")).over(Window.partitionBy(key))
    return found.withColumn("_some", some).where("_some = 0 or level = 'child'").drop("_some")


def few(keys: DataFrame) -> DataFrame:
    """A stored table of keys, marked to be sent to all tasks if it has ``SENT`` rows at most: what it is joined with then stays where it is."""
    return F.broadcast(keys) if keys.limit(SENT + 1).count() <= SENT else keys


def of_pairs(pairs: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The ``rows`` whose key a stored table of pairs (a, b) names."""
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct(), "wanted")
    return rows.join(few(wanted), key, "left_semi")


def near_duplicates(docs: DataFrame, key: str, group: str, text: Column, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """(a, b, similarity): pairs of a group whose word shingles have a Jaccard of ``threshold`` or more.

    Exact and without all pairs: shingles are ordered by rarity, and two texts of that similarity must
    share one of the first size - ceil(threshold * size) + 1 shingles of each; those prefixes meet.
    Shingles that a single text has come first in that order and meet nothing, so they leave with one
    count and only take up places; of the others a pair that meets at some place must still be able to
    share enough of what follows it. Exact copies (equal shingle sets, told by two hashes of the set)
    are folded into one row first and expanded as (first, copy). Shingles are compared by their 64-bit
    hashes. They meet by 40 bits of the hash with the group's, which takes less to move; what meets by
    chance is a candidate more and fails the comparison. Only texts of candidate pairs move their hashes.
    """
    sets = docs.select(F.col(key).alias("k"), F.col(group).alias("g"), F.array_sort(F.array_distinct(F.transform(T.shingles(text, n), lambda x: F.xxhash64(x)))).alias("s")).where("size(s) > 0")
    sets = written(sets.withColumn("h", F.xxhash64("s")).withColumn("h2", F.xxhash64(F.lit(1), F.col("s"))), "shingles")
    first = sets.groupBy("g", "h", "h2").agg(F.min("k").alias("a"), F.count(F.lit(1)).alias("m"))
    copied = written(sets.select("g", "h", "h2", "k").join(first.where("m > 1").drop("m"), ["g", "h", "h2"]).where("k <> a").select("a", "k"), "copies")
    copies = copied.select("a", F.col("k").alias("b"), F.lit(1.0).alias("similarity"))
    folded = sets.where("g is not null").join(few(copied.select("k")), "k", "left_anti")

    # the code comes last and ends with zeros, so that rows of a text differ in five bytes only
    code = F.shiftrightunsigned(F.xxhash64("x", "g"), 24).alias("x")
    df = F.count(F.lit(1)).over(Window.partitionBy("x"))
    shared = folded.select("k", "g", F.size("s").alias("n"), F.explode("s").alias("x")).select("k", "n", code).withColumn("df", df).where("df > 1")
    shared = shared.withColumn("alone", F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("k")))
    at = F.row_number().over(Window.partitionBy("k").orderBy("df", "x")) + F.col("alone")
    prefix = written(shared.withColumn("at", at).where(F.col("at") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1).select("k", "x", "n", "at"), "prefixes")
    one = prefix.select(F.col("k").alias("a"), "x", F.col("n").alias("na"), F.col("at").alias("pa"))
    two = prefix.select(F.col("k").alias("b"), "x", F.col("n").alias("nb"), F.col("at").alias("pb"))
    # at their first meeting two texts share at most what is left of either, and must share t / (1 + t) of both
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1
    fit = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    met = one.join(two, "x").where(fit).withColumn("left", left)
    pairs = met.groupBy("a", "b").agg(F.max("left").alias("left"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    pairs = pairs.where(F.col("left") >= F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-9).select("a", "b")
    pairs = written(pairs, "candidates")
    some = of_pairs(pairs, sets.select("k", "g", "s"), "k")
    side = lambda k: some.select(F.col("k").alias(k), F.col("g").alias(f"g{k}"), F.col("s").alias(f"s{k}"))
    checked = pairs.join(side("a"), "a").join(side("b"), "b").where("ga = gb").select("a", "b", T.jaccard(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= threshold)
    return checked.unionByName(copies)


def near_owner(pairs: DataFrame, first: str, second: str, first_is_canonical: Column) -> DataFrame:
    """(duplicate, duplicate_of): of the pairs in order of (first, second) the earliest names a duplicate's owner; chains stay."""
    named = pairs.select(F.when(first_is_canonical, F.col(second)).otherwise(F.col(first)).alias("duplicate"), F.when(first_is_canonical, F.col(first)).otherwise(F.col(second)).alias("owner"), F.struct(first, second).alias("at"))
    return named.groupBy("duplicate").agg(F.min_by("owner", "at").alias("duplicate_of"))


def with_parent(children: DataFrame, rows: DataFrame, group: list[str], parent: str, key: str, text: str) -> DataFrame:
    """``children`` (group, key, parent) with ``parent_text``, the text of the row that ``parent`` names."""
    above = rows.select(*[F.col(c).alias(f"_{c}") for c in group], F.col(key).alias("_key"), F.col(text).alias("parent_text"))
    on = [children[c] == F.col(f"_{c}") for c in group] + [children[parent] == F.col("_key")]
    return children.join(above, on, "left").select(*group, key, "parent_text")
