"""Column helpers for log text.  ``.`` matches all but a line feed, cases fold by Unicode."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ANY_CASE = "(?iud)"


def content(c: Column) -> Column:
    """A null text counts as empty."""
    return F.coalesce(c, F.lit(""))


def lines(c: Column) -> Column:
    return F.split(content(c), "\n", -1)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once: a lambda would evaluate what it captures for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def any_of(patterns: Sequence[str], flags: str = ANY_CASE) -> str:
    """One alternation of patterns, so that a text is read once."""
    return flags + "|".join(f"(?:{p})" for p in patterns)


def has_any(lowered: Column, words: Sequence[str]) -> Column:
    """Whether a lower-cased text contains one of ``words``."""
    out = F.lit(False)
    for w in words:
        out = out | lowered.contains(w)
    return out


def times(lowered: Column, word: str) -> Column:
    """How often ``word`` stands in a text without overlap; only texts that have it are gone through letter by letter."""
    gone = F.length(lowered) - F.length(F.replace(lowered, F.lit(word), F.lit("")))
    return F.when(lowered.contains(word), (gone / len(word)).cast("long")).otherwise(F.lit(0).cast("long"))


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """Estimated tokens: a quarter of the characters, rounded down."""
    return F.floor(F.length(content(c)) / 4)
