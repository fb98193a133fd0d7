"""Places for models: functions from Columns to a Column, by name, with deterministic stand-ins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import ranking

_ADAPTERS: dict[str, Callable[..., Column]] = {}


def register(name: str, function: Callable[..., Column]) -> None:
    _ADAPTERS[name] = function


def get(name: str) -> Callable[..., Column]:
    return _ADAPTERS[name]


def hash_embedding(text: Column, size: int = 16) -> Column:
    """Token counts by hash, of unit length; for tests and plumbing, not for meaning."""
    buckets = F.transform(T.tokenize(text), lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))
    counts = T.let(buckets, lambda bs: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(bs, lambda b: b == i)).cast("double")))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    return T.let(counts, lambda c: T.let(norm(c), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(0.0))))


register("embedder", hash_embedding)
register("reranker", lambda score, terms, text: ranking.overlap_boost(score, terms, text))
register("generator", lambda titles: F.array_join(F.transform(titles, lambda t: F.concat(F.lit("- "), t)), "\n"))
