"""Benchmark decontamination by template canonicalisation; DataFrame operations only.

Numbers, names and units become typed placeholders, so a question with other parameters has the same
template. Windows of five template words of the benchmark are hashed and broadcast in batches of a
bounded size; the documents' windows meet them by a hash join without a shuffle. A document holds an
item if at least 0.8 of the item's windows are found and the slots agree: every value of the item
stands for one value of the document throughout (two values may become the same one). Matches on
diagonals a few words apart are one copy, so a word put in or left out does not split it; the windows
of one copy count together, or those of the whole document where all its slots agree.

A window of the benchmark with fewer than three literal words has a template that any table of
numbers or list of names shares. Such windows meet documents by their own words instead. So do all
others besides, in lower case: a document also holds an item if 0.8 of all the item's windows are
there word for word in any case, whatever became a placeholder on either side.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import written

WORDS, COVERAGE = 5, 0.8
#: Windows with fewer literal words than this meet by their own words only.
LITERALS = 3
#: Benchmark windows in one broadcast: five numbers, below 100 bytes in the hash table, so 50 MB at most.
BATCH = 500_000
#: Diagonals at most so many words apart belong to one copy.
SLIP = 8

#: Placeholders from the private use area, and unit words that may follow a number.
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
UNITS = ("mm", "cm", "m", "km", "meter", "meters", "metre", "metres", "mile", "miles", "inch", "inches", "feet", "foot", "ft", "mg", "g", "kg", "gram", "grams", "ton", "tons", "pound", "pounds", "lb", "lbs", "ounce", "ounces", "ml", "l", "liter", "liters", "litre", "litres", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "percent", "dollar", "dollars", "euro", "euros", "cent", "cents", "degree", "degrees", "kb", "mb", "gb", "hz", "khz", "mhz", "ghz", "watt", "watts", "kw", "volt", "volts")

#: Ends of a marked number, and of a marked name or unit.
CLOSE, END = "\ue003", "\ue004"
#: Private use characters of the text itself are removed first.
MARKS = r"[\x{E000}-\x{E004}]"

SPACE = r"[\x20\x09-\x0D]+"
STRIP = r"[^\p{L}\p{N}\x{E000}-\x{E004}\x20\x09-\x0D]+"
NAMES = r"(?=\p{Lu})(?<=[^.!?:\x20\x09-\x0D][\x20\x09])[\p{L}'-]++"
NUMBERS = r"[0-9]++(?:[.,:/][0-9]++)*+"
UNIT_AFTER = rf"(\x{{E000}}[^\x{{E003}}]*\x{{E003}}[\x20\x09]?)({'|'.join(UNITS)})([^\p{{L}}\p{{N}}]|$)"
MARKED = r"([\x{E000}-\x{E002}])[^\x{E003}\x{E004}]*[\x{E003}\x{E004}]"


def marked(text: Column) -> Column:
    """The text lower-cased, without punctuation, its numbers, names and units between marks.

    A name is a capitalised word that opens no sentence or line. One cutting of this text gives both
    the template's words and the literal ones.
    """
    marks = NUMBER + NAME + UNIT + CLOSE + END
    text = F.when(functools.reduce(lambda a, m: a | m, (text.contains(m) for m in marks)), F.translate(text, marks, "")).otherwise(text)
    text = F.regexp_replace(text, NAMES, f"{NAME}$0{END}")
    text = F.regexp_replace(text, NUMBERS, f"{NUMBER}$0{CLOSE}")
    text = F.regexp_replace(F.lower(text), UNIT_AFTER, f"$1{UNIT}$2{END}$3")
    return F.regexp_replace(text, STRIP, "")


def cut(table: DataFrame, key: str) -> DataFrame:
    """(key, t, own, slots): the words of the template, the literal words and the places where the two differ."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table.select(F.col(key).cast("long").alias(key), F.filter(F.split(marked(text), SPACE), lambda w: w != "").alias("w"))

    def holds(w: Column) -> Column:
        return w.contains(CLOSE) | w.contains(END)

    rows = rows.select(
        key,
        F.transform("w", lambda w: F.when(holds(w), F.regexp_replace(w, MARKED, "$1")).otherwise(w)).alias("t"),
        F.transform("w", lambda w: F.when(holds(w), F.regexp_replace(w, MARKS, "")).otherwise(w)).alias("own"),
        F.filter(F.transform("w", lambda w, i: F.when(holds(w), i)), lambda i: i.isNotNull()).alias("slots"),
    )
    return rows


def _hash(words: str, at: str, size: int) -> str:
    """Hash of the window of ``words`` from ``at`` on; fewer words make one window of them all, tagged by their number."""
    five = ", ".join(f"{words}[{at} + {k}]" for k in range(size))
    return f"if(size({words}) >= {size}, xxhash64({five}), xxhash64(size({words}), array_join({words}, ' ')))"


def _starts(size: int) -> str:
    return f"if(size(t) > 0, sequence(0, greatest(size(t) - {size}, 0)), array())"


def document_windows(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """(doc_id, own, pos, by_template, h): a row for each window's template, and one for its literal words where a slot is in it.

    Without a slot the two are the same. The words are cut once for each row; what is exploded only
    refers to them.
    """
    rows = cut(docs, "doc_id").where("doc_id is not null")
    # the windows that a slot lies in
    rows = rows.withColumn("at", F.expr(f"array_distinct(flatten(transform(slots, i -> sequence(greatest(i - {size - 1}, 0), least(i, greatest(size(t) - {size}, 0))))))"))
    rows = rows.select("doc_id", "own", "at", F.expr(f"transform({_starts(size)}, i -> {_hash('t', 'i', size)})").alias("ht"), F.expr(f"transform(at, i -> {_hash('own', 'i', size)})").alias("hl"))
    # the outer form: the inner one would add a filter below that computes the windows once more
    rows = rows.select("doc_id", "own", "at", F.size("ht").alias("m"), F.posexplode_outer(F.concat("ht", "hl")).alias("p", "h")).where("h is not null")
    return rows.select("doc_id", "own", F.expr("if(p < m, p, at[p - m])").alias("pos"), (F.col("p") < F.col("m")).alias("by_template"), "h")


def benchmark_windows(benchmark: DataFrame, size: int = WORDS, literals: int = LITERALS) -> DataFrame:
    """(item_id, h, ipos, how, mask, iv, total, said): the windows of each item.

    ``how`` is 1 for a template, 2 for literal words, 3 where both are the same. ``mask`` has a bit for
    each slot and ``iv`` the literal words of a window with slots. ``total`` counts an item's windows,
    ``said`` those with a template of their own. Items of fewer words than a window only match
    documents that consist of the same words, whatever they are.
    """
    rows = cut(benchmark, "item_id").where("item_id is not null")
    rows = rows.select("item_id", "t", "own", F.posexplode_outer(F.expr(f"transform({_starts(size)}, i -> struct({_hash('t', 'i', size)} as t, {_hash('own', 'i', size)} as l))")).alias("ipos", "hs")).where("hs is not null")
    rows = rows.select("item_id", F.size("t").alias("n"), "ipos", "hs", F.slice("t", F.col("ipos") + 1, size).alias("w"), F.slice("own", F.col("ipos") + 1, size).alias("iv"))
    marks = F.array(F.lit(NUMBER), F.lit(NAME), F.lit(UNIT))
    bits = F.transform("w", lambda x, i: F.when(F.array_contains(marks, x), F.call_function("shiftleft", F.lit(1), i)).otherwise(0))
    rows = rows.withColumn("mask", F.aggregate(bits, F.lit(0), lambda a, x: a + x))
    rows = rows.withColumn("says", (F.col("n") < size) | (F.size("w") - F.bit_count("mask") >= literals))
    rows = rows.select("item_id", "ipos", "mask", F.when(F.col("mask") > 0, F.col("iv")).alias("iv"), "says", F.explode(F.array(F.struct(F.when(F.col("says"), F.col("hs.t")).alias("h"), F.lit(1).alias("how")), F.struct(F.col("hs.l").alias("h"), F.lit(2).alias("how")))).alias("e"))
    total = rows.groupBy("item_id").agg(F.count_distinct("ipos").alias("total"), F.count_distinct(F.when(F.col("says"), F.col("ipos"))).alias("said"))
    rows = rows.where("e.h is not null").groupBy("item_id", F.col("e.h").alias("h"), "ipos", "mask", "iv").agg(F.bit_or("e.how").alias("how"))
    return rows.join(total, "item_id")


def met(own: DataFrame, side: DataFrame, batch: int, *columns) -> DataFrame:
    """``columns`` of the windows ``own`` that meet ``side`` by h, which is broadcast ``batch`` rows at a time."""
    batches = max(1, math.ceil(side.count() / batch))
    found = None
    for k in range(batches):
        part = side if batches == 1 else side.where(F.pmod(F.col("h"), F.lit(batches)) == k)
        rows = own.join(F.broadcast(part), "h").select(*columns)
        found = rows if found is None else found.unionByName(rows)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WORDS, coverage: float = COVERAGE, batch: int = BATCH) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, coverage, kind) for every document that holds an item.

    ``kind`` is verbatim, or reparameterised where a slot's value differs. The counts are of the
    windows with a template of their own where these suffice, else of all windows word for word. Null
    texts and texts or items without words match nothing; rows without an id take no part; rows that
    repeat count once; further columns are ignored; an empty table on either side gives an empty
    result. A very long text costs its length: its words are cut once, and a match takes its five
    words from them.
    """
    bench = written(benchmark_windows(benchmark, size), "benchmark")
    how = F.when(F.col("by_template"), F.col("how")).otherwise(F.col("how").bitwiseAND(2))
    # the document's words are taken only where a template with slots has met
    dv = F.when((F.col("mask") > 0) & (how.bitwiseAND(1) > 0), F.slice("own", F.col("pos") + 1, size))
    found = met(document_windows(docs, size), bench.select("h", "item_id", "ipos", "mask", F.col("how")), batch, "doc_id", "item_id", "h", (F.col("pos") - F.col("ipos")).alias("diag"), "ipos", how.alias("how"), dv.alias("dv"))
    found = written(found.where("how > 0").distinct(), "leaks")
    said = bench.where("(how & 1) = 1").select("item_id", "h", "ipos", "said", "mask", "iv")
    pairs = F.expr("coalesce(filter(transform(iv, (x, i) -> if((mask & shiftleft(1, i)) = 0, null, struct(x as i, dv[i] as d))), p -> p is not null), array())")
    some = found.where("(how & 1) = 1").join(said, ["item_id", "h", "ipos"]).select("doc_id", "item_id", "said", "diag", "ipos", pairs.alias("p"))
    order = Window.partitionBy("doc_id", "item_id").orderBy("diag")
    some = some.withColumn("jump", (F.col("diag") - F.lag("diag").over(order) > SLIP).cast("int"))
    some = some.withColumn("part", F.sum(F.coalesce("jump", F.lit(1))).over(order))
    # each copy by itself, and all of them as one
    some = some.withColumn("part", F.explode(F.array("part", F.lit(0).cast("long"))))
    copy = some.groupBy("doc_id", "item_id", "part").agg(F.first("said").alias("n_windows"), F.count_distinct("ipos").alias("n_matched"), F.array_distinct(F.flatten(F.collect_set("p"))).alias("p"))
    copy = copy.where(F.size("p") == F.size(F.array_distinct(F.transform("p", lambda x: x["i"])))).withColumn("moved", F.exists("p", lambda x: x["i"] != x["d"]))
    copy = copy.select("doc_id", "item_id", F.lit(1).alias("kind"), "moved", "n_windows", "n_matched")
    total = bench.select("item_id", "total").distinct()
    same = found.where("(how & 2) = 2").groupBy("doc_id", "item_id").agg(F.count_distinct("ipos").alias("n_matched")).join(total, "item_id")
    same = same.select("doc_id", "item_id", F.lit(2).alias("kind"), F.lit(False).alias("moved"), F.col("total").alias("n_windows"), "n_matched")
    both = copy.unionByName(same).withColumn("coverage", F.col("n_matched") / F.col("n_windows")).where(F.col("coverage") >= coverage)
    item = both.groupBy("doc_id", "item_id").agg(F.min(F.struct("kind", -F.col("n_matched"), "moved", "n_windows", "n_matched", "coverage")).alias("b"))
    return item.select("doc_id", "item_id", "b.n_windows", "b.n_matched", "b.coverage", F.when(F.col("b.moved"), "reparameterised").otherwise("verbatim").alias("kind"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold an item by its template or by its words in any case; all columns stay."""
    held = contaminated(docs, benchmark, **options)
    held = written(held.select(F.col("doc_id").alias("_held")).distinct(), "held")
    return docs.join(held, docs["doc_id"] == held["_held"], "left_anti")
