"""Column functions on text, shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = "([a-z0-9]+)"


def strip_ws(text: Column) -> Column:
    """Both ends without white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def terms(text: Column) -> Column:
    """Lower-case ASCII alphanumeric terms, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(1))


def content_terms(text: Column, stop: list[str], longer_than: int = 2) -> Column:
    """Distinct terms that are longer than a limit and no stop words."""
    kept = F.filter(terms(text), lambda t: (F.length(t) > longer_than) & ~t.isin(stop))
    return F.array_distinct(kept)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def titleize(slug: Column) -> Column:
    """Words of a slug with their first letters upper-cased and the rest as it is."""
    words = F.filter(F.split(slug, r"[-_\s]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def join_present(separator: str, *parts: Column) -> Column:
    """Parts that are neither null nor empty, joined."""
    return F.concat_ws(separator, *[F.nullif(p, F.lit("")) for p in parts])


def sentences(text: Column) -> Column:
    """Pieces of a text, cut at white space after a full stop, exclamation or question mark."""
    return F.split(text, r"(?<=[.!?])\s+")


def last_sentences(text: Column, n: int = 2, longer_than: int = 20) -> Column:
    """The last ``n`` sentences of more than ``longer_than`` characters, fenced lines left out."""
    outside = F.regexp_replace(text, r"(?ms)^[ \t]*```.*?(^[ \t]*```[^\n]*\n?|\z)", "")
    flat = strip_ws(F.regexp_replace(outside, "\n", " "))
    long = F.filter(sentences(flat), lambda s: F.length(s) > longer_than)
    start = F.greatest(F.size(long) - n, F.lit(0)) + 1
    return F.array_join(F.slice(long, start, n), " ")


def point_id(child_id: Column) -> Column:
    """63-bit integer from the first eight bytes of the id's SHA-256."""
    whole = F.conv(F.substring(F.sha2(child_id, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.floor(whole / 2).cast("long")


def garble_ratio(text: Column, ranges: str = r"\u0530-\u058F\u0590-\u05FF\u0480-\u04FF") -> Column:
    """Share of characters within suspicious code point ranges; 0 for an empty text."""
    clean = F.regexp_replace(text, f"[{ranges}]", "")
    return F.when(F.length(text) > 0, (F.length(text) - F.length(clean)) / F.length(text)).otherwise(0.0)


def try_pattern(pattern: str) -> str:
    """A user's regular expression in Java's dialect; raises ValueError if it does not compile."""
    import re

    try:
        re.compile(pattern)
    except re.error as error:
        raise ValueError(f"invalid pattern: {error}") from None
    return pattern.replace("(?P<", "(?<")


def place(below: Column) -> dict[str, Column]:
    """``slug``, ``domain`` and ``suffix`` of a path below its root: the domain is the first folder, else ``general``."""
    parts = F.split(below, "/")
    name = F.element_at(parts, -1)
    return {
        "slug": F.regexp_replace(name, r"\.[^.]*$", ""),
        "domain": F.when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise("general"),
        "suffix": F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)),
    }
