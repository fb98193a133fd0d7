"""Predicates and small rewrites on URLs, titles, queries and page blocks; all vocabulary is a parameter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import let


def matches(text: Column, pattern: str) -> Column:
    """Whether the pattern is found, in any case; false for null."""
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))


def holds_any(text: Column, parts: list[str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts], F.lit(False)), F.lit(False))


def official_category(url: Column, marker: str, ids: list[str]) -> Column:
    """A category URL: the marker, and one of the ids."""
    return F.coalesce(F.contains(url, F.lit(marker)), F.lit(False)) & holds_any(url, ids)


def language_error(text: Column, lang: Column) -> Column:
    """Null where a text has enough letters of its language, else what is wrong.

    Arabic needs 20 Arabic letters or 0.15 of the Latin ones, other languages 30 Latin letters and at
    most half as many Arabic ones.
    """
    def judge(counts: Column) -> Column:
        arabic, latin = counts["a"], counts["l"]
        fits = F.when(lang == "ar", (arabic >= 20) | (arabic >= 0.15 * latin)).otherwise((latin >= 30) & (arabic <= 0.5 * latin))
        return F.when(~F.coalesce(fits, F.lit(False)), F.concat(F.lit("language_mismatch:"), F.coalesce(lang, F.lit("?"))))

    counts = F.struct(F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[؀-ۿ]")).alias("a"), F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[A-Za-z]")).alias("l"))
    return let(counts, judge)


def model_tier(query: Column, complex_pattern: str, longest: int = 120) -> Column:
    """The larger model for complex or long queries."""
    return F.when(matches(query, complex_pattern) | (F.length(query) > longest), "large").otherwise("small")


def applicable_rate(query: Column, context: Column, local_query: str, local_marker: str, head: int = 4000) -> Column:
    """A percentage in the context, and a local marker near its front if the query asks for the local one."""
    near = matches(F.substring(context, 1, head), local_marker)
    return matches(context, r"[0-9]+ ?%") & (~matches(query, local_query) | near)


def title_from_id(doc_id: Column, url: Column, marker: str = "ProductID") -> Column:
    """The id's product, else the URL's last route segment, else what follows the id's first underscore; spaces for separators."""
    product = F.nullif(F.regexp_extract(doc_id, rf"{marker}=([^&/]+)", 1), F.lit(""))
    segment = F.nullif(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"/([^/]+)/?$", 1), F.lit(""))
    rest = F.nullif(F.regexp_extract(doc_id, r"^[^_]*_(.*)$", 1), F.lit(""))
    return F.trim(F.regexp_replace(F.coalesce(product, segment, rest, doc_id), r"[-_ ]+", " "))


def without_prefix(title: Column, prefix: str, shortest: int = 3, generic: list[str] = ()) -> Column:
    """The title without the site's prefix, unless what is left is short or generic."""
    rest = F.trim(F.regexp_replace(title, f"(?i)^{prefix} *[-|:] *", ""))
    return F.when((F.length(rest) < shortest) | F.lower(rest).isin(list(generic)), title).otherwise(rest)


def expand_words(query: Column, words: dict[str, str], expansions: list[tuple[str, str]]) -> Column:
    """Words replaced by the map, then the first matching rule's expansion appended."""
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    plain = F.array_join(F.transform(F.split(F.lower(F.trim(query)), " +"), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")

    def extended(text: Column) -> Column:
        more = F.lit("")
        for pattern, extra in reversed(expansions):
            more = F.when(matches(text, pattern), F.lit(f" {extra}")).otherwise(more)
        return F.concat(text, more)

    return let(plain, extended)


def rewritten(query: Column, colloquial: list[tuple[str, str]], words: dict[str, str], expansions: list[tuple[str, str]], entities: list[tuple[str, int]]) -> Column:
    """Colloquial patterns, word map and expansion, then the first entities of each kind (pattern, how many)."""
    text = F.lower(F.trim(query))
    for pattern, new in colloquial:
        text = F.regexp_replace(text, pattern, new)
    low = F.lower(query)
    found = F.concat(*[F.slice(F.array_distinct(F.regexp_extract_all(low, F.lit(p), F.lit(0))), 1, n) for p, n in entities])
    return F.trim(F.array_join(F.concat(F.array(expand_words(text, words, expansions)), found), " "))


def table_truncated(rows: Column) -> Column:
    """Markdown of array<array<string>>, every row padded or cut to the header's width."""
    def render(all_rows: Column) -> Column:
        width = F.size(all_rows[0])
        cell = lambda c: F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|"))
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width), cell), " | "), F.lit(" |"))
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
        return F.array_join(F.concat(F.array(line(all_rows[0]), rule), F.transform(F.slice(all_rows, F.lit(2), F.greatest(F.size(all_rows) - 1, F.lit(0))), line)), "\n")

    return F.when(F.size(rows) > 0, let(rows, render)).otherwise("")


def admitted_lines(text: Column, furniture: str) -> Column:
    """Trimmed lines of two characters or more that are neither furniture nor one block of base64."""
    keep = lambda x: (F.length(x) >= 2) & ~matches(x, furniture) & ~F.replace(x, F.lit(" "), F.lit("")).rlike(r"^[A-Za-z0-9+/=]{100,}$")
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), keep), "\n")


def kept_blocks(blocks: Column, skip: list[str], furniture: Column, shortest_link: int = 28) -> Column:
    """Blocks (tag, text) without skipped tags, furniture lines, single characters and short links; of each text the first."""
    norm = lambda b: F.lower(F.trim(F.regexp_replace(b["text"], r"[ \t\n]+", " ")))

    def keep(b: Column) -> Column:
        low = norm(b)
        return ~F.lower(b["tag"]).isin(skip) & (F.length(low) > 1) & ~F.array_contains(furniture, low) & (~F.lower(b["tag"]).isin("a", "button") | (F.length(low) >= shortest_link))

    def first_of_each(own: Column) -> Column:
        names = F.transform(own, norm)
        return let(names, lambda ns: F.filter(own, lambda b, i: F.array_position(ns, norm(b)) == i + 1))

    return let(F.filter(blocks, keep), first_of_each)


def inline_tables(blocks: Column, tables: Column) -> Column:
    """Text of blocks (tag, text), each followed by the tables (head, body) whose head it is the first to name; the rest under '## Tables'.

    Headings get as many marks as their level.
    """
    def render(own: Column) -> Column:
        home = F.transform(tables, lambda t: F.array_position(F.transform(own, lambda b: F.contains(F.lower(b["text"]), F.lower(t["head"]))), True))

        def lines(places: Column) -> Column:
            of = lambda n: F.transform(F.filter(F.arrays_zip(tables.alias("t"), places.alias("p")), lambda z: z["p"] == n), lambda z: z["t"]["body"])
            level = lambda b: F.when(F.lower(b["tag"]).rlike("^h[1-6]$"), F.concat(F.repeat(F.lit("#"), F.substring(b["tag"], 2, 1).cast("int")), F.lit(" "))).otherwise("")
            body = F.flatten(F.transform(own, lambda b, i: F.concat(F.array(F.concat(level(b), b["text"])), of(i + 1))))
            return let(of(F.lit(0)), lambda left: F.array_join(F.concat(body, F.when(F.size(left) > 0, F.concat(F.array(F.lit("## Tables")), left)).otherwise(F.array().cast("array<string>"))), "\n"))

        return let(home, lines)

    return let(blocks, render)


def field_split(text: Column, markers: list[str], least: int) -> Column:
    """A text of more than ``least`` four-character tokens with two markers or more, cut before each marker; else itself."""
    mark = "|".join(markers)
    many = (F.floor(F.length(text) / 4) > least) & (F.regexp_count(text, F.lit(f"(?m)^({mark})")) >= 2)
    return F.when(many, F.filter(F.split(text, rf"(?m)^(?=(?:{mark}))"), lambda p: F.trim(p) != "")).otherwise(F.array(text))
