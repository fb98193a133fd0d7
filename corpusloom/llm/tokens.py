"""Token counts by a two-tier lookup on the map side.

Pre-tokens are counted, not shuffled: a first pass keeps a bounded summary of frequent words in each
task, the summaries' sums name the most frequent, and the token lengths of those travel to every
worker as one small table. A worker encodes what the table lacks with the library and keeps the
lengths in a bounded cache of its own. The table and the caches only save time; every count is the
library's. Texts of Latin letters are cut into pre-tokens by a spelt-out pattern, all others by the
library's own pre-tokenizer, whose Unicode tables decide; both meet the same two tiers.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_batches, resource_path

#: Entries of the frequent tier; with words of 32 bytes at most, it is below 2 MB.
FREQUENT = 32_768
#: Words that one task's summary holds and reports, and the longest word in it.
SUMMARY, REPORT, LONGEST = 65_536, 4_096, 32
#: Entries of a worker's cache and their most characters (60 MB at most); it starts anew when full.
CACHE, KEPT = 300_000, 64
#: Texts with a code point above this are cut by the library's pre-tokenizer.
PLAIN = 0x24F


def plain_pattern() -> str:
    """The pre-token pattern of the rank files with its classes spelt out up to ``PLAIN``."""
    group: dict[str, list[int]] = {"L": [], "N": []}
    for i in range(PLAIN + 1):
        group.setdefault(unicodedata.category(chr(i))[0], []).append(i)

    def spans(codes: list[int]) -> str:
        out, start = [], None
        for i, c in enumerate(codes):
            start = c if start is None else start
            if i + 1 == len(codes) or codes[i + 1] != c + 1:
                out.append(f"\\u{start:04x}-\\u{c:04x}")
                start = None
        return "".join(out)

    letter, number, space = spans(group["L"]), spans(group["N"]), "\\t-\\r \\x85\\xa0"
    return f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"


class TokenCounter:
    """Token counts of whole texts for one byte-level BPE file."""

    def __init__(self, name: str, frequent: dict[str, int] | None = None):
        import re

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(resource_path(name))
        self.library.no_truncation()
        self.library.no_padding()
        specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.specials = specials
        self.odd = re.compile(f"[^\\x00-\\u{PLAIN:04x}]")
        self.findall = re.compile(plain_pattern()).findall
        self.cut = self.library.pre_tokenizer.pre_tokenize_str
        library = self.library
        self.asked = self.encoded = 0

        class Lengths(dict):
            def __missing__(own, token):
                n = len(library.encode(token, add_special_tokens=False).ids)
                self.encoded += 1
                if len(own) > CACHE:
                    own.clear()
                    own.update(frequent or {})
                if len(token) <= KEPT:
                    own[token] = n
                return n

        self.lengths = Lengths(frequent or {})

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if self.odd.search(text):
            return [text[a:b] for _, (a, b) in self.cut(text)]
        return self.findall(text)

    def __call__(self, text: str) -> int:
        if any(s in text for s in self.specials):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        pieces = self.pieces(text)
        self.asked += len(pieces)
        return sum(map(self.lengths.__getitem__, pieces))


def frequent_words(docs: DataFrame, top: int = FREQUENT) -> list[str]:
    """The most frequent words, from summaries that every task makes of all its texts."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(text.split())
                if len(seen) > 4 * SUMMARY:
                    seen = Counter(dict(seen.most_common(SUMMARY)))
        best = [(w, n) for w, n in seen.most_common(REPORT * 2) if len(w) <= LONGEST][:REPORT]
        yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in best], pa.string()), "n": pa.array([n for _, n in best], pa.int64())})

    sums = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in sums.orderBy(F.desc("n"), "word").limit(top).collect()]


def frequent_lengths(words: list[str], name: str) -> dict[str, int]:
    """Lengths of the pre-tokens of ``words``, at the start of a text or after a space."""
    count = TokenCounter(name)
    tokens = {t for w in words for t in (*count.pieces(w), *count.pieces(f" {w}")) if len(t) <= LONGEST + 1}
    return {sys.intern(t): count.lengths[t] for t in tokens}


def token_counts(docs: DataFrame, name: str = "byte_bpe_50k.json", limit: int = 512, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs`` (doc_id, text).

    A null text counts as empty: 0 bytes, 0 tokens. Rows that repeat come out as often as they came,
    a null doc_id stays null, further columns are ignored, an empty table gives an empty result. A
    very long text costs its own length, and a long pre-token is not kept. A text that spells a
    special token goes to the library whole, which is what decides there.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    table = spark.sparkContext.broadcast(frequent_lengths(frequent_words(docs, frequent), name))

    def run(batches):
        count = TokenCounter(name, table.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([count(t) for t in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = out.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
