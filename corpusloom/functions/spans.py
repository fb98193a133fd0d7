"""Matches of patterns with their places, and one reading of a text out of overlapping ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import let

_SPANS = "array<struct<start:int,end:int,value:string>>"


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>>: all matches of a pattern that never matches nothing, in code points, the end exclusive.

    The parts between the matches are as many and one more, so lengths add up to places.
    """

    def placed(both: Column) -> Column:
        found, between = both["m"], both["p"]
        step = lambda s, i: let(
            s["at"] + F.length(F.get(between, i)),
            lambda a: let(F.get(found, i), lambda m: F.struct((a + F.length(m)).alias("at"), F.array_append(s["out"], F.struct(a.alias("start"), (a + F.length(m)).alias("end"), m.alias("value"))).alias("out"))),
        )
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(found) - 1, F.lit(0))), lambda i: i < F.size(found))
        return F.aggregate(places, begin, step, lambda s: s["out"])

    whole = F.coalesce(text, F.lit(""))
    return let(F.struct(F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)).alias("m"), F.split(whole, pattern, -1).alias("p")), placed)


def entities(text: Column, kinds: list[tuple[str, str]]) -> Column:
    """array<struct<start, end, kind, value>>: matches of (kind, pattern) that do not overlap, in order of place.

    An earlier kind takes its matches first, from left to right; later kinds get what is left whole.
    """

    def typed(rank: int, kind: str, pattern: str) -> Column:
        return F.transform(located(text, pattern), lambda s: F.struct(F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))

    every = F.array_sort(F.flatten(F.array(*[typed(i, *k) for i, k in enumerate(kinds)])))
    none = F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>")
    free = lambda taken, s: ~F.exists(taken, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"]))
    kept = F.aggregate(every, none, lambda taken, s: F.when(free(taken, s), F.array_append(taken, F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))).otherwise(taken))
    return F.array_sort(kept)
