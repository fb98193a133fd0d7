"""URL, hash and identifier functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def unquote(text: Column) -> Column:
    """Percent-decoding that keeps plus signs and leaves what cannot be decoded."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def canonicalize(url: Column) -> Column:
    """Decoded once, scheme and host in lower case, slashes of the path single; query and fragment stay."""
    raw = unquote(F.trim(F.coalesce(url, F.lit(""))))
    shape = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(.*)$"
    part = lambda k: F.regexp_extract(raw, shape, k)
    whole = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.regexp_replace(part(3), "/{2,}", "/"), part(4))
    return F.when(raw.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), whole).otherwise(raw)


def key(url: Column) -> Column:
    return F.lower(canonicalize(url))


def document_id(url: Column, raw: bool = False) -> Column:
    """First 16 hex digits of the SHA-256 of the canonical (or the raw) URL."""
    return F.substring(F.sha2(url if raw else canonicalize(url), 256), 1, 16)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def route_slug(url: Column) -> Column:
    """The route after '#/', without a language and a query."""
    return F.regexp_extract(url, r"#/(?:AR/|EN/)?([^?]*)", 1)


def json_parameter(url: Column, name: str, field: str) -> Column:
    """A field of the JSON that a URL parameter carries; empty on any error."""
    raw = unquote(F.regexp_extract(url, f"{name}=([^&#]*)", 1))
    return F.coalesce(F.lower(F.get_json_object(raw, f"$.{field}")), F.lit(""))


def canonicity(url: Column) -> Column:
    """Higher for shorter, plainer URLs."""
    low = F.lower(url)
    route = F.regexp_extract(url, "#/(.*)$", 1)
    number = lambda text, what: F.regexp_count(text, F.lit(what))
    return (
        -F.least(F.length(url), F.lit(500)) / 500.0
        - number(low, "%") * 0.15
        - number(low, " ") * 0.2
        - F.when(low.contains("productdetails"), 0.4).otherwise(0.0)
        + F.when(low.contains("productcategory"), 0.3).otherwise(0.0)
        - F.when(low.contains("newcontent") | low.contains("undefined"), 1.0).otherwise(0.0)
        - F.when(low.rlike("typo|old|legacy"), 0.5).otherwise(0.0)
        - number(route, "/") * 0.05
        - number(route, r"\{") * 0.2
    )


def language(url: Column, codes: dict[str, str], default: str) -> Column:
    """The first code whose path part the URL has."""
    out = F.lit(default)
    for part, code in reversed(list(codes.items())):
        out = F.when(url.contains(part), code).otherwise(out)
    return out


def is_http(url: Column) -> Column:
    return F.coalesce(url.rlike("^https?://"), F.lit(False))


def admitted(url: Column, hosts: list[str], excluded: list[str] = ()) -> Column:
    """One scheme, no white space, a known host and none of the excluded markers."""
    known = "|".join(rf"(^|\.){re.escape(h)}$" for h in hosts)
    ok = (F.regexp_count(url, F.lit("https?://")) == 1) & ~url.rlike(r"\s") & F.regexp_extract(url, "^https?://([^/?#]*)", 1).rlike(known)
    for marker in excluded:
        ok = ok & ~F.lower(url).contains(marker.lower())
    return F.coalesce(ok, F.lit(False))
