"""String mapping and parsing, without Python functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keyword lists in order of priority; trailing spaces tell words apart.
OWNER_KEYWORDS = {
    "government": ["COUNTY", "CITY OF", "STATE OF", "UNITED STATES", "BOARD OF"],
    "corporate": ["INC", "CORP", "CO ", "GROUP"],
    "llc": ["LLC", "L L C", "LP", "LTD"],
    "trust": ["TRUST", "TRUSTEE", "TR "],
    "estate": ["ESTATE", "ESTATE OF", "DECD"],
}
_NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_NULLS = ("", "N/A", "NA", "NULL", "-")


def strip(c: Column) -> Column:
    """All white space at both ends, not spaces alone."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def owner_type(name: Column) -> Column:
    upper = F.upper(name)
    out = F.lit("individual")
    for label, words in reversed(OWNER_KEYWORDS.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | upper.contains(w)
        out = F.when(hit, label).otherwise(out)
    return F.when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(out)


def slug(name: Column, size: int = 60) -> Column:
    dashed = F.regexp_replace(F.lower(strip(name)), "[^a-z0-9]+", "_")
    return F.substring(F.regexp_replace(dashed, "^_+|_+$", ""), 1, size)


#: Fixed value: what a mailing address may begin with and isn't part of it.
ADDRESSEE = r"(?i)^\s*(ATTN[:\s]+|C/O\s+|CO\s+)"


def mailing(*parts: Column) -> Column:
    """The parts that aren't blank joined by a blank, less one addressee mark at the start of the whole; empty if there is nothing."""
    bare = [F.nullif(strip(p), F.lit("")) for p in parts]
    return strip(F.regexp_replace(F.concat_ws(" ", *bare), ADDRESSEE, ""))


def lenient_double(c: Column) -> Column:
    """Null on any failure; no money signs are taken away."""
    bare = strip(c)
    return F.when(bare.rlike(_NUMBER), bare.try_cast("double"))


def lenient_long(c: Column) -> Column:
    """Cut towards zero."""
    return lenient_double(c).try_cast("long")


def text_or_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


#: Counties of the one market and the market of all others.
COUNTIES = ("fulton", "dekalb", "cobb", "gwinnett", "clayton", "henry", "spalding", "fayette")
MARKET = "Atlanta"


def market_of(county: Column) -> Column:
    """struct(market, used_default)."""
    known = F.coalesce(F.lower(strip(county)).isin(*COUNTIES), F.lit(False))
    return F.struct(F.lit(MARKET).alias("market"), (~known).alias("used_default"))


def marker(c: Column, pattern: str, last: bool = True) -> Column:
    """The last (or first) match of a pattern's first group, null if there is none."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1 if last else 1))


def json_or_empty(c: Column) -> Column:
    """map<string,string> of a JSON object; anything else is an empty map."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` computed once, however often it uses it."""
    return F.transform(F.array(value), body)[0]


def number(c: Column) -> Column:
    """struct(value, bad): money signs, separators and percent signs are ignored; null words are null; the rest is bad."""

    def told(bare: Column) -> Column:
        empty = bare.isNull() | F.upper(bare).isin(*_NULLS)
        value = F.when(~empty & bare.rlike(_NUMBER), bare.try_cast("double"))
        return once(value, lambda v: F.struct(v.alias("value"), (~empty & v.isNull()).alias("bad")))

    return once(strip(F.regexp_replace(c, "[$,%]", "")), told)


def date(c: Column) -> Column:
    """Four formats, in order."""
    text = strip(c)
    return F.coalesce(*[F.try_to_date(text, f) for f in ("yyyy-M-d", "M/d/yyyy", "yyyy-M-d'T'H:m:s", "yyyy/M/d")])


def redact(text: Column) -> Column:
    for pattern, word in ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+", "[EMAIL]"), (r"[+][0-9][ ().0-9-]{8,}[0-9]", "[PHONE]")):
        text = F.regexp_replace(text, pattern, word)
    return text
