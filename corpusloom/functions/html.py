"""HTML as arrays of tags and texts, inside the JVM.

A page is cut into tags and texts by one pattern. Elements that are left out (by name, or by what
their class or id holds) are found by one fold over the pieces: it remembers the tag that began the
element and how deep that tag is nested, and adds an interval when the element ends. The pieces
between the intervals are what a reader sees.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import let

#: Comments, declarations and elements whose content is no markup; what never ends goes on to the end.
RAW = r"(?is)<!--.*?(?:-->|\z)|<(script|style|iframe|noscript)\b[^>]*>.*?(?:</\1\s*>|\z)|<[!?][^>]*>"
#: A tag with its quoted values, a text, or a '<' that begins no tag.
REST = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
PIECE = rf"</?[a-zA-Z]{REST}|[^<]++|<"
TAG = r"^</?[a-zA-Z]"
SKIPPED = ("nav", "header", "footer", "aside", "svg")
#: What a class or an id may hold that marks an element to leave out (class, then id).
MARKED = (("FooterContainer", "chat-wrapper", "badge", "chatbot", "Chatbot"), ("Footer", "Header"))
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
NAMED = (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def pieces(html: Column) -> Column:
    """array<string>: tags and texts in their order; what ``RAW`` takes out parts the texts around it like a line break."""
    return F.regexp_extract_all(F.regexp_replace(F.coalesce(html, F.lit("")), RAW, "<br>"), F.lit(PIECE), F.lit(0))


def tag_name(piece: Column) -> Column:
    return F.lower(F.regexp_extract(piece, r"^</?([a-zA-Z][a-zA-Z0-9:-]*)", 1))


def _attribute(piece: Column, name: str) -> Column:
    return F.regexp_extract(piece, rf"""(?i)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", 1)


def _marked(piece: Column, names: tuple[str, ...], marks: tuple[tuple[str, ...], ...]) -> Column:
    out = tag_name(piece).isin(*names)
    for attribute, held in zip(("class", "id"), marks):
        for mark in held:
            out = out | F.contains(_attribute(piece, attribute), F.lit(mark))
    return out


def visible(found: Column, names: tuple[str, ...] = SKIPPED, marks: tuple[tuple[str, ...], ...] = MARKED) -> Column:
    """The pieces outside of elements that are left out; an element that is never closed goes on to the end."""

    def described(p: Column, i: Column) -> Column:
        is_tag = p.rlike(TAG)
        void = tag_name(p).isin(*VOID) | p.endswith("/>")
        kind = F.when(~is_tag, 0).when(p.startswith("</"), -1).when(void, 2).otherwise(1)
        return F.struct(F.when(is_tag, tag_name(p)).otherwise("").alias("n"), kind.alias("k"), F.coalesce(is_tag & _marked(p, names, marks), F.lit(False)).alias("s"), i.alias("i"))

    none = F.lit(None).cast("string")
    state = lambda tag, depth, start, done: F.struct(tag.alias("tag"), depth.alias("depth"), start.alias("start"), done.alias("done"))
    zero = F.lit(0)

    def step(s: Column, x: Column) -> Column:
        deeper = s["depth"] + F.when(x["k"] == 1, 1).when(x["k"] == -1, -1).otherwise(0)
        ended = lambda start: F.array_append(s["done"], F.struct(start.alias("a"), x["i"].alias("b")))
        outside = F.when(x["s"] & (x["k"] == 1), state(x["n"], F.lit(1), x["i"], s["done"])).when(x["s"] & (x["k"] == 2), state(none, zero, zero, ended(x["i"]))).otherwise(s)
        inside = F.when(x["n"] != s["tag"], s).when(deeper == 0, state(none, zero, zero, ended(s["start"]))).otherwise(state(s["tag"], deeper, s["start"], s["done"]))
        return F.when(s["tag"].isNull(), outside).otherwise(inside)

    def kept(p: Column) -> Column:
        begin = state(none, zero, zero, F.array().cast("array<struct<a:int,b:int>>"))
        end = F.aggregate(F.transform(p, described), begin, step, lambda s: F.when(s["tag"].isNull(), s["done"]).otherwise(F.array_append(s["done"], F.struct(s["start"].alias("a"), F.size(p).alias("b")))))

        def between(done: Column) -> Column:
            gaps = F.sequence(zero, F.size(done))
            first = lambda r: F.coalesce(F.get(done, r - 1)["b"] + 1, zero)
            last = lambda r: F.coalesce(F.get(done, r)["a"], F.size(p))
            return F.flatten(F.transform(gaps, lambda r: F.slice(p, first(r) + 1, F.greatest(last(r) - first(r), zero))))

        return let(end, between)

    return let(found, kept)


def unescaped(text: Column) -> Column:
    """Numbered characters and the common named ones; others stay as they are written."""

    def number(p: Column) -> Column:
        hexed = F.regexp_extract(p, r"^&#[xX]([0-9a-fA-F]{1,6});$", 1)
        decimal = F.regexp_extract(p, r"^&#([0-9]{1,7});$", 1)
        code = F.when(hexed != "", F.conv(hexed, 16, 10).cast("long")).when(decimal != "", decimal.cast("long"))
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(p)

    numbered = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("&#[0-9a-fA-FxX]+;|[^&]+|&"), F.lit(0)), number), "")
    out = F.when(F.contains(text, F.lit("&#")), numbered).otherwise(text)
    for name, plain in NAMED:
        out = F.replace(out, F.lit(name), F.lit(plain))
    return out


def squashed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r\xA0]+", " "))


def texts(kept: Column) -> Column:
    """The texts among pieces, unescaped; neighbours that no tag parts are two."""
    return F.transform(F.filter(kept, lambda p: ~p.rlike(TAG)), unescaped)


def lines(kept: Column, furniture: str) -> Column:
    """Lines of the texts: squashed, two characters or more, no furniture, no base64; of lines equal but for case the first."""
    split = F.flatten(F.transform(texts(kept), lambda t: F.split(t, r"\r\n|[\n\r\x0B\f]")))
    clean = F.filter(F.transform(split, squashed), lambda x: (F.length(x) >= 2) & ~x.rlike(furniture) & ~F.replace(x, F.lit(" "), F.lit("")).rlike(r"^[A-Za-z0-9+/=]{100,}$"))
    # the place of each line's first like is the smallest of its own
    first = lambda ls: let(F.transform(ls, F.lower), lambda low: F.filter(ls, lambda x, i: F.array_position(low, F.get(low, i)) == i + 1))
    return let(clean, first)


def title(kept: Column, url: Column, furniture: str, generic: tuple[str, ...] = ()) -> Column:
    """The title element; where that is empty or generic the first heading of four characters that is no furniture; else the end of the URL's fragment, or the URL."""

    def chosen(page: Column) -> Column:
        plain = lambda t: squashed(unescaped(F.regexp_replace(t, f"</?[a-zA-Z]{REST}", " ")))
        own = plain(F.regexp_extract(page, rf"(?is)<title\b{REST}(.*?)</title\s*>", 1))
        heads = F.transform(F.regexp_extract_all(page, F.lit(rf"(?is)<(h[1-3])\b{REST}(.*?)</\1\s*>"), F.lit(2)), plain)
        head = F.get(F.filter(heads, lambda h: (F.length(h) >= 4) & ~h.rlike(furniture)), F.lit(0))
        fragment = F.nullif(F.regexp_extract(url, r"#(?:[^?]*/)?([^/?]*)", 1), F.lit(""))
        empty = lambda t: F.lower(t).isin("", *generic)
        return let(own, lambda t: F.when(~empty(t), t).otherwise(F.coalesce(F.when(~empty(head), head), fragment, url)))

    return let(F.array_join(kept, ""), chosen)
