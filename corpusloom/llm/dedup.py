"""Exact duplicates by a tree merge of sorted digest runs.

A row's digest is the SHA-256 of its text without white space. Each scan task sorts its rows by digest
and folds equal ones into one entry: that is its run. Partitions are numbered in bits; a round joins
up those whose numbers differ in four bits only, and each entry goes to the one of them that agrees
with its digest there. The sorter merges the runs that arrive (it spills what memory does not hold)
and one pass over them retains the first entry of each digest with the counts summed. After the last
round a partition holds every entry of its digests: no task ever sees all of them, and a digest that a
third of all rows share reaches a partition once from each of its sixteen partners.

The way back goes by the first runs: an entry learns its group's owner, then the rows of a partition
learn it from their own run, so rows of a large group are never dealt by their digest alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_batches, written

#: Deleted before texts are compared.
WHITE = " \t\n\x0b\x0c\r"
#: A round's partners are the partitions that differ in this many bits.
ROUND_BITS = 4
#: Entries that a partition holds in the end, on average, at most.
RUN_ROWS = 1 << 18
#: Partitions are named by digest bits; so many at most.
MOST_BITS = 16

ENTRY = "part int, home int, digest binary, second long, n long, doc_id long, row long, members long"
ENTRY_NAMES = ["part", "home", "digest", "second", "n", "doc_id", "row", "members"]


def bare(text: Column) -> Column:
    """Text without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digests(docs: DataFrame) -> DataFrame:
    """(part, row, doc_id, n, digest, second): one row per document; ``second`` is another hash of the same text, which verifies that equal digests are equal texts."""
    text = bare(F.col("text"))
    return docs.select(
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.xxhash64(text).alias("second"),
    )


def in_order() -> list:
    """Entries of one digest stand together, the one that stays first."""
    return ["part", "digest", "second", F.desc("n"), F.asc_nulls_last("doc_id"), "row"]


def fold(batches):
    """The first of consecutive entries with the same partition, digest and second hash, with their members summed."""
    held = None
    for batch in batches:
        rows = pa.table([batch.column(c) for c in ENTRY_NAMES], ENTRY_NAMES)  # without what is said on nulls
        if held is not None:
            rows = pa.concat_tables([held, rows])
        rows = rows.combine_chunks()
        if not rows.num_rows:
            continue
        digest = np.frombuffer(b"".join(rows["digest"].to_pylist()), np.uint64).reshape(-1, 4)
        second, part, members = (rows[c].to_numpy() for c in ("second", "part", "members"))
        new = np.any(digest[1:] != digest[:-1], axis=1) | (second[1:] != second[:-1]) | (part[1:] != part[:-1])
        starts = np.concatenate([[0], np.flatnonzero(new) + 1])
        out = rows.take(pa.array(starts)).set_column(rows.schema.get_field_index("members"), "members", pa.array(np.add.reduceat(members, starts), pa.int64()))
        yield from out.slice(0, out.num_rows - 1).to_batches()
        held = out.slice(out.num_rows - 1)
    if held is not None:
        yield from held.to_batches()


def first_runs(rows: DataFrame, bits: int) -> DataFrame:
    """The runs of ``rows`` (see ``digests``) as entries, folded within each scan task."""
    home = F.shiftright(F.conv(F.substring(F.hex("digest"), 1, MOST_BITS // 4), 16, 10).cast("int"), MOST_BITS - bits)
    entries = rows.select("part", home.alias("home"), "digest", "second", "n", "doc_id", "row", F.lit(1).cast("long").alias("members"))
    return entries.sortWithinPartitions(*in_order()).mapInArrow(fold, ENTRY)


def merged(runs: DataFrame, bits: int) -> DataFrame:
    """One entry per digest: ``runs`` after all rounds among 2 ** ``bits`` partitions."""
    out = runs.withColumn("part", F.col("part").bitwiseAND(F.lit((1 << bits) - 1)))
    for low in range(0, max(bits, 1), ROUND_BITS):
        swapped = ((1 << min(bits, low + ROUND_BITS)) - 1) ^ ((1 << low) - 1)
        to = F.col("part").bitwiseAND(F.lit(~swapped)).bitwiseOR(F.col("home").bitwiseAND(F.lit(swapped)))
        out = out.withColumn("part", to).repartitionById(1 << bits, F.col("part")).sortWithinPartitions(*in_order()).mapInArrow(fold, ENTRY)
    return out


def exact_duplicates(docs: DataFrame, round_rows: int = RUN_ROWS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs`` (doc_id, text).

    Texts are equal when they are so without white space; null counts as empty, and texts of white
    space are equal to it. Of equal texts the longest stays, of those the smallest doc_id, a null one
    after all others, and of rows that repeat that too a single one, so each group keeps exactly one
    row; ``keep_id`` is its doc_id. Texts of any length are hashed whole. Further columns are ignored;
    an empty table gives an empty result. Digests that agree while the second hash does not are
    different texts.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = written(digests(docs), "digests")
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // round_rows + 1)
    bits = min(MOST_BITS, (wanted - 1).bit_length())
    runs = written(first_runs(rows, bits), "runs")
    owners = merged(runs, bits).where("members > 1").select("digest", "second", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), "members")
    # a run that two scan tasks read comes in two entries
    told = runs.select("part", "digest", "second").join(written(owners, "owners"), ["digest", "second"]).dropDuplicates(["part", "digest", "second"])
    out = rows.join(told, ["part", "digest", "second"], "left")
    alone = F.col("members").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("members", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
