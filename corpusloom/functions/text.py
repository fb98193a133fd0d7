"""Text functions: Column in, Column out. All run inside the JVM but ``nfkc``."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Arabic ranges and letter variants, markers of page furniture, function words.
AR_DIACRITICS = "[ؐ-ًؚ-ٰٟۖ-ۭ]"
AR_VARIANTS = ("أإآٱىة", "اااايه")
PLAIN = "^[\u0000-\u009F\u0621-\u0674\u06D6-\u06EF]*$"
TATWEEL = "ـ"
AR_PREFIXES = ("وبال", "فبال", "وال", "بال", "كال", "فال", "لل", "ال")
AR_SUFFIXES = ("اتها", "اتهم", "اتكم", "اتنا", "اتك", "ها", "هم", "هما", "كم", "كن", "نا", "ات", "ين", "ون", "ه")
STOPWORDS_EN = ("the and for are was were been does did how what when where which who whom why can could should would will shall may might must you your she its they them their this that these those with about from please tell show give get want need like his her him our not but any all to of in on at by is it as be or an do we into nearest closest nearby").split()
STOPWORDS_AR = ("من في علي عن الي ما ماذا هو هي هما كيف هل او و ثم هذا هذه ذلك تلك الذي التي الذين اي ايه عند مع بعد قبل بين كل بعض لا لم لن ان انه انها كان كانت ليس هناك لو مين فين امتي ازاي ليه حد").split()
PLACEHOLDERS = r"(?i)(\{\{[^}]+\}\}|%\{[^}]+\}%|\[\[[^\]]+\]\]|null\s*undefined|TODO_CONTENT|lorem ipsum)"
FOOTERS = ("all rights reserved", "follow us")
CHROME = ("Consumer Protection", "Retail Segments", "Main Menu")
NAV_LINE = r"(?i)^(Welcome|Logout|Main Menu|Notifications|Favorite List|Follow Up|Consumer Protection)([^a-z0-9_]|$)"
WIDGET_LINE = r"(?i)(swiper|cookie|subscribe|newsletter|chatbot|whatsapp widget|share this|print this)"
#: Four or more entries of up to forty characters after pipes; written so that no position is tried twice.
PIPE_MENU = r"(?:\|(?=[^\n|]{2})[ \t]*+[^\n|]{0,40}?[ \t]*+(?=\|)){3}\|[^\n|]{2}"
BASE64 = r"(data:image/[a-zA-Z0-9.+-]+;base64,)?[A-Za-z0-9+/]{100,}={0,2}"

NBSP = "\u00a0"
SPACE = r"[ \t\n\x0B\f\r]+"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; an expression used inside a lambda is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squash(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC, for which Spark has no function; only call it on rows that need it."""
    import unicodedata

    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalize_arabic(text: Column, compatibility: bool = False) -> Column:
    """Letters unified, diacritics and tatweel dropped, white space squashed.

    With ``compatibility``, presentation forms and other compatibility characters are folded first,
    whatever they are; rows of ASCII and Arabic letters only, which that never changes, stay as they are.
    """
    if compatibility:
        text = F.when(text.rlike(PLAIN), text).otherwise(nfkc(text))
    text = F.regexp_replace(text, AR_DIACRITICS, "")
    text = F.translate(text, AR_VARIANTS[0] + TATWEEL, AR_VARIANTS[1])
    return squash(text)


def normalize(text: Column, lang: Column) -> Column:
    return F.when(lang == "ar", normalize_arabic(text)).otherwise(squash(text))


def tokenize(text: Column, lang: Column | str = "en", shortest: int = 2) -> Column:
    """Arabic runs of the normalised text, or Latin runs of the lower-cased one."""
    latin = F.regexp_extract_all(F.lower(text), F.lit(f"[a-z]{{{shortest},}}"), F.lit(0))
    if isinstance(lang, str):
        return latin if lang != "ar" else F.regexp_extract_all(normalize_arabic(text), F.lit(f"[؀-ۿ]{{{shortest},}}"), F.lit(0))
    return F.when(lang == "ar", F.regexp_extract_all(normalize_arabic(text), F.lit("[؀-ۿ]{2,}"), F.lit(0))).otherwise(latin)


def query_terms(text: Column, aliases: dict[str, str] | None = None) -> Column:
    """Ordered distinct Latin terms of three letters or more, mapped through aliases."""
    terms = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))
    if aliases:
        known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
        terms = F.transform(terms, lambda t: F.coalesce(F.try_element_at(known, t), t))
    return F.array_distinct(terms)


def spacing_aliases(text: Column, aliases: dict[str, str]) -> Column:
    """Word-bounded, case-insensitive replacements, one after another."""
    return functools.reduce(lambda t, kv: F.regexp_replace(t, rf"(?i)\b{kv[0]}\b", kv[1]), aliases.items(), text)


def stem_ar(token: Column, least: int = 3) -> Column:
    """One prefix, then one suffix, the first in list order that leaves ``least`` letters."""
    front = "|".join(f"{p}(?=.{{{least},}}$)" for p in AR_PREFIXES)
    token = F.regexp_replace(token, f"^(?:{front})", "")
    out = token
    for s in reversed(AR_SUFFIXES):
        fits = (F.length(token) - len(s) >= least) & token.endswith(s)
        out = F.when(fits, F.substring(token, F.lit(1), F.length(token) - len(s))).otherwise(out)
    return out


def stem_en(token: Column) -> Column:
    n = F.length(token)
    cut = lambda k: F.substring(token, F.lit(1), n - k)
    return (
        F.when((n >= 7) & token.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n >= 6) & token.rlike("(ses|xes|zes|ches|shes)$"), cut(2))
        .when((n >= 5) & token.endswith("s") & ~token.rlike("(ss|us|is)$"), cut(1))
        .otherwise(token)
    )


def without_stopwords(tokens: Column, words: Sequence[str] = tuple(STOPWORDS_EN)) -> Column:
    """Order and repeats stay, unlike with ``array_except``."""
    stop = F.array(*map(F.lit, words))
    return F.filter(tokens, lambda t: ~F.array_contains(stop, t))


def plural_variants(tokens: Column) -> Column:
    """Tokens and, for those of three letters, the forms with -s and -es, each once."""
    more = F.transform(tokens, lambda t: F.when(F.length(t) >= 3, F.array(t, F.concat(t, F.lit("s")), F.concat(t, F.lit("es")))).otherwise(F.array(t)))
    return F.array_distinct(F.concat(tokens, F.flatten(more)))


def bigram_phrases(tokens: Column) -> Column:
    """Neighbouring tokens of three letters or more, joined by a space."""
    empty = F.array().cast("array<string>")

    def pairs(ts: Column) -> Column:
        long = lambda i: F.length(F.get(ts, i)) >= 3
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ts) - 1)), lambda i: long(i - 1) & long(i))
        return F.when(F.size(ts) > 1, F.transform(places, lambda i: F.concat_ws(" ", F.get(ts, i - 1), F.get(ts, i)))).otherwise(empty)

    return let(tokens, pairs)


def strip_html(text: Column) -> Column:
    """Scripts, styles and tags out, entities as spaces; only where both angle brackets occur."""

    def bare(t: Column) -> Column:
        out = F.regexp_replace(t, r"(?is)<(script|style|noscript|iframe|svg)[^>]*>.*?</(script|style|noscript|iframe|svg)>", " ")
        out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
        return F.when(t.contains("<") & t.contains(">"), F.regexp_replace(out, r"<[^>]+>", "\n")).otherwise(t)

    return F.regexp_replace(let(text, bare), r"(?i)&(nbsp|amp|lt|gt|quot|#[0-9]+);", " ")


def strip_chrome(text: Column, markers: Sequence[str] = CHROME) -> Column:
    """What follows the first marker of the list that lies in the first 70 % of the text."""

    def after(t: Column) -> Column:
        out = t
        for m in reversed(markers):
            at = F.instr(t, m) - 1
            out = F.when((at >= 0) & (at < F.length(t) * 0.7), F.regexp_replace(F.substring(t, at + 1 + len(m), F.length(t)), r"^[ |\-]+|[ |\-]+$", "")).otherwise(out)
        return out

    return let(text, after)


def cut_footer(text: Column, markers: Sequence[str] = FOOTERS) -> Column:
    """Ends at the earliest first occurrence of a marker that lies beyond 55 % of the text."""

    def cut(t: Column, low: Column) -> Column:
        ats = [F.instr(low, m) - 1 for m in markers]
        return F.rtrim(F.substring(t, F.lit(1), F.least(F.length(t), *[F.when(a > F.floor(F.length(t) * 0.55), a) for a in ats])))

    return let(text, lambda t: let(F.lower(t), lambda low: cut(t, low)))


def drop_placeholders(text: Column) -> Column:
    return F.regexp_replace(text, PLACEHOLDERS, " ")


def filter_lines(text: Column) -> Column:
    """Lines stripped; menus, widgets and repeats of the line kept before go; blank runs shrink to one."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    lines = F.filter(lines, lambda x: ~(x.rlike(NAV_LINE) | x.rlike(WIDGET_LINE) | x.rlike(PIPE_MENU)))
    return F.array_join(let(lines, lambda ls: F.filter(ls, lambda x, i: (i == 0) | (x != F.get(ls, i - 1)))), "\n")


def clean_document(text: Column, lang: Column | None = None, keep_newlines: bool = False) -> Column:
    """Markup, furniture, placeholders, footer and lines, then spaces; newlines go unless asked for."""
    text = drop_placeholders(strip_chrome(strip_html(text)))
    text = filter_lines(cut_footer(text))
    if keep_newlines:
        return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))
    return squash(text) if lang is None else let(text, lambda t: normalize(t, lang))


def strip_base64(text: Column) -> Column:
    """Base64 runs of 100 characters, image markers, and long tokens of at least 16 kinds of base64 characters."""
    text = F.regexp_replace(text, BASE64, " ")
    text = F.regexp_replace(text, r"iVBORw0KGgo(?s:.){0,20}|AAAAAElFTkSuQmCC", " ")
    noisy = lambda t: (F.length(t) >= 100) & t.rlike("^[A-Za-z0-9+/=]+$") & (F.size(F.array_distinct(F.split(t, ""))) >= 16)
    text = F.when(text.rlike(r"[A-Za-z0-9+/=]{100}"), F.array_join(F.filter(F.split(text, " "), lambda t: ~noisy(t)), " ")).otherwise(text)
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def block_key(text: Column) -> Column:
    """Key of a text block: noise out, no-break spaces as spaces, squashed, lower case."""
    return F.lower(squash(F.translate(strip_base64(text), NBSP, " ")))


def table_markdown(rows: Column) -> Column:
    """Ragged rows as a markdown table as wide as the widest; rows of empty cells go, pipes are escaped."""
    cell = lambda c: F.replace(squash(F.translate(F.coalesce(c, F.lit("")), NBSP, " ")), F.lit("|"), F.lit("\\|"))
    rows = F.filter(F.transform(rows, lambda r: F.transform(r, cell)), lambda r: F.exists(r, lambda c: c != ""))

    def render(rows: Column, width: Column) -> Column:
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
        lines = F.transform(rows, line)
        return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, 1_000_000)), "\n")

    return let(rows, lambda rs: F.when(F.size(rs) > 0, let(F.array_max(F.transform(rs, lambda r: F.size(r))), lambda w: render(rs, w))).otherwise(""))


def table_block(rows: Column) -> Column:
    """Rows of non-empty cells between table marks."""
    line = lambda r: F.array_join(F.filter(F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != ""), " | ")
    lines = F.filter(F.transform(rows, line), lambda x: x != "")
    return F.when(F.size(lines) > 0, F.concat(F.lit("[TABLE]\n"), F.array_join(lines, "\n"), F.lit("\n[/TABLE]"))).otherwise("")


def render_blocks(blocks: Column) -> Column:
    """Text blocks (tag, text): headings as '## ', body text longer than two characters, other tags out."""
    body = F.array(*map(F.lit, ("p", "li", "td", "th", "span", "div", "strong", "b", "label")))
    text = lambda x: F.trim(F.coalesce(x["text"], F.lit("")))
    one = lambda x: F.when(F.lower(x["tag"]).rlike("^h[1-6]$") & (text(x) != ""), F.concat(F.lit("\n## "), text(x), F.lit("\n"))).when(F.array_contains(body, F.lower(x["tag"])) & (F.length(text(x)) > 2), text(x))
    return F.array_join(F.filter(F.transform(blocks, one), lambda x: x.isNotNull()), "\n")


def snippet(text: Column, terms: Column, chars: int = 240, before: int = 60) -> Column:
    """A window around the earliest term, cut at spaces with ellipses; without a hit the head."""
    text = squash(F.lower(text))
    at = let(text, lambda x: F.array_min(F.filter(F.transform(terms, lambda t: F.instr(x, t)), lambda p: p > 0))) - 1
    n = F.length(text)
    start0 = F.greatest(F.lit(0), at - before)
    end = F.least(n, start0 + chars)
    start = F.greatest(F.lit(0), F.least(start0, end - chars))
    cut = F.trim(F.substring(text, start + 1, end - start))
    cut = F.when(n > end, F.concat(F.regexp_replace(cut, r" [^ ]*$", ""), F.lit("…"))).otherwise(cut)
    cut = F.when(start > 0, F.concat(F.lit("…"), F.regexp_replace(F.ltrim(cut), r"^[^ ]* ", ""))).otherwise(cut)
    head = F.when(n > chars, F.regexp_replace(F.substring(text, 1, chars), r" [^ ]*$", "")).otherwise(text)
    return F.when(at.isNull(), head).otherwise(cut)


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def highlight(text: Column, terms: Sequence[str]) -> Column:
    """Terms between marks, the longest first, whatever the case."""
    import re

    some = "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)) if t)
    return F.regexp_replace(text, f"(?i)({some})", "<mark>$1</mark>") if some else text


def word_windows(text: Column, max_tokens: int = 280, overlap: int = 50) -> Column:
    """Overlapping word windows: one if the text has ``max_tokens`` (of four characters), else windows of 4/3 as many words."""
    size = max(8, max_tokens * 4 // 3)
    step = max(1, size - max(2, overlap * 4 // 3))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    count = lambda ws: F.ceil(F.greatest(F.lit(0), F.size(ws) - size) / step).cast("int")
    many = let(words, lambda ws: F.transform(F.sequence(F.lit(0), count(ws)), lambda k: F.array_join(F.slice(ws, k * step + 1, F.lit(size)), " ")))
    return F.when(F.floor(F.length(text) / 4) <= max_tokens, F.array(F.trim(text))).otherwise(many)


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct word n-grams of the lower-cased text; fewer words make one, none make none."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_']+"), F.lit(0))
    empty = F.array().cast("array<string>")
    grams = lambda ws: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ws) - n + 1)), lambda i: F.array_join(F.slice(ws, i, F.lit(n)), " "))
    return let(words, lambda ws: F.when(F.size(ws) == 0, empty).otherwise(F.array_distinct(grams(ws))))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def sections(answer: Column, headers: Sequence[str] = ("Answer", "Summary", "Key Information", "Product", "Source")) -> Column:
    """Map of '### ' sections; text before the first known header is the answer."""
    known = F.array(*map(F.lit, headers))
    parts = F.split(F.concat(F.lit("\n"), answer), "\n### ")
    name = lambda p: F.trim(F.substring_index(p, "\n", 1))
    rest = lambda p: F.trim(F.regexp_replace(p, r"^[^\n]*\n?", ""))
    pairs = F.transform(parts, lambda p: F.when(F.array_contains(known, name(p)), F.struct(name(p).alias("k"), rest(p).alias("v"))).otherwise(F.struct(F.lit("Answer").alias("k"), F.trim(p).alias("v"))))
    return F.map_from_entries(F.filter(pairs, lambda x: x["v"] != ""))


def wrap_answer(answer: Column, product: Column, source: Column) -> Column:
    """Answers with headers stay; others get Product, Summary or Answer, Key Information and Source."""
    plain = F.concat(F.lit("### Answer\n"), answer, F.lit("\n\n### Key Information\n"), answer, F.lit("\n\n### Source\n"), source)
    goods = F.concat(F.lit("### Product\n"), product, F.lit("\n\n### Summary\n"), answer, F.lit("\n\n### Key Information\n"), answer, F.lit("\n\n### Source\n"), source)
    return F.when(answer.contains("###"), answer).when(product.isNotNull(), goods).otherwise(plain)
