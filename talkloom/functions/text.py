"""Column functions on text.  White space and word classes are Unicode's, as ``(?U)`` sets them."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Tokens that a dialogue corpus writes for punctuation (fixed values).
PUNCTUATION = {"_comma_": ",", "_period_": ".", "_question_": "?", "_exclamation_": "!", "_quote_": '"', "_apos_": "'", "_dash_": "-"}
#: Words that the similarity of two texts leaves out (fixed values).
SIMILARITY_STOP = ("a", "the", "and", "or", "in", "with", "to", "for", "of", "on", "at")
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
PHONE = r"\b\+?[\d][\d\s\-\(\)\.]{8,}\d\b"


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def words(x: Column) -> Column:
    """The parts between white space; none for null."""
    return F.filter(F.split(F.coalesce(x, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def n_words(x: Column) -> Column:
    return F.size(words(x)).cast("bigint")


def contains_any(x: Column, phrases: tuple[str, ...] | list[str]) -> Column:
    """Whether ``x`` has one of the phrases, as they stand; null counts as empty."""
    x = F.coalesce(x, F.lit(""))
    out = F.lit(False)
    for p in phrases:
        out = out | x.contains(p)
    return out


def unescape(x: Column) -> Column:
    """HTML character references decoded: XML's five are easy, the other two thousand need Python."""

    @F.pandas_udf(StringType())
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(html.unescape, na_action="ignore")

    return decode(x)


def tidy(x: Column) -> Column:
    """Tags out, punctuation tokens restored, blanks to one space, none before punctuation."""
    x = F.regexp_replace(x, "<[^>]+>", "")
    for token, mark in PUNCTUATION.items():
        x = F.replace(x, F.lit(token), F.lit(mark))
    x = strip(F.regexp_replace(x, r"[ \t]+", " "))
    return F.regexp_replace(x, r"(?U)\s+([,.?!:;])", "$1")


def clean_text(x: Column) -> Column:
    """``tidy`` of the decoded text.  Only rows with an ampersand need Python."""
    return tidy(F.when(x.contains("&"), unescape(x)).otherwise(x))


def similarity_tokens(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0)))


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two distinct-token arrays without stop words; 0 if either is empty."""
    stop = F.array(*map(F.lit, SIMILARITY_STOP))
    left, right = F.array_except(a, stop), F.array_except(b, stop)
    both = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - both
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (union == 0), 0.0).otherwise(both / union)


def similarity(a: Column, b: Column) -> Column:
    return token_similarity(similarity_tokens(a), similarity_tokens(b))


def scrub(x: Column) -> Column:
    """E-mail addresses and phone numbers masked, in that order."""
    return F.regexp_replace(F.regexp_replace(x, EMAIL, "[EMAIL]"), PHONE, "[PHONE]")


def preview(x: Column, n: int) -> Column:
    """One line of ``n`` characters at most, with an ellipsis where it was cut."""
    flat = F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.substring(flat, 1, n), F.lit("…")))


def rolling_hash(x: Column) -> Column:
    """Polynomial hash (base 31, modulo 2^32) mapped to 1000..9999."""
    codes = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    h = F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, c: F.pmod(a * 31 + c, F.lit(1 << 32)))
    return F.lit(1000) + F.pmod(h, F.lit(9000))


def clock(seconds: Column) -> Column:
    """Seconds as hh:mm:ss."""
    s = F.floor(seconds).cast("int")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("int"), F.pmod(s, F.lit(60)))


def nearest_rank(values: Column, p: float) -> Column:
    """The value at half-even-rounded rank p/100 (n - 1) of an array; null if it is empty."""
    ranked = F.array_sort(values)
    return F.when(F.size(values) > 0, F.get(ranked, F.bround(F.lit(p / 100) * (F.size(values) - 1)).cast("int")))


def short_hash(x: Column) -> Column:
    """The first eight hex digits of SHA-1."""
    return F.substring(F.sha1(x), 1, 8)
