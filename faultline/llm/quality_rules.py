"""Quality rules (operator 11): a table of thresholds compiled into one projection; DataFrame functions only.

A rule holds a share of one count in another between two bounds, in percent, so that verdicts are whole-number comparisons and the
same everywhere.  All counts of a text come from one pass of array and regular-expression functions; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let

#: What stands between words.
WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Words of a window that is looked for twice.
WINDOW = 8
#: Texts of fewer words fail, and those of which more than so many percent of the words stand in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
# The commonest function words of English, French, German and Spanish
STOP_WORDS = (
    "the of and to a in is that it for was on with be by as are this from at or an have not "
    "de la le et des les en un du que une pour est qui par pas au dans sur avec ce il "
    "der die und den von zu das mit dem auf für sich im nicht ist ein als eine auch es "
    "el y los se del las por su no una con para al lo como más pero"
).split()


class Rule(NamedTuple):
    """``part`` makes up ``least`` to ``most`` percent of ``whole`` (None: no bound); a text whose ``whole`` is 0 passes."""

    name: str
    part: str
    whole: str
    least: int | None
    most: int | None


RULES = (
    Rule("word_length", "word_chars", "n_words", 300, 1000),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("lettered_words", "n_lettered_words", "n_words", 80, None),
    Rule("stop_words", "n_stop_words", "n_words", 5, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 60),
    Rule("listed_lines", "n_listed_lines", "n_lines", None, 80),
    Rule("cut_lines", "n_cut_lines", "n_lines", None, 30),
)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words of an array (a bound variable or column) stand in runs of ``window`` words that occur at two places or more.

    Runs are told apart by 64-bit hashes.  Only texts with a repeated hash have theirs sorted.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - window, F.lit(0)))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))

    def covered(order: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(order, j)["h"] == x["h"], F.lit(False))
        at = F.transform(order, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["at"]))
        step = lambda p: F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(window)), F.lit(window)))
        return F.aggregate(let(F.array_sort(F.array_compact(at)), step), F.lit(0), lambda n, x: n + x)

    def of_hashes(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(placed, covered)).otherwise(0)

    return F.when(F.size(words) > window, let(hashes, of_hashes)).otherwise(0)


def counts(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """A struct of all counts (long) that rules may name; a null text has none of anything."""
    known = [*dict.fromkeys(x for w in stop_words for x in (w, w[:1].upper() + w[1:]))]

    def of_text(t: Column) -> Column:
        words = F.filter(F.split(t, WHITE, -1), lambda w: w != "")
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        count = lambda pattern: F.regexp_count(t, F.lit(pattern))
        of_words = lambda w: F.struct(F.size(w).alias("n_words"), F.size(F.filter(w, lambda x: x.isin(known))).alias("n_stop_words"), repeated_words(w).alias("n_repeat_words"))
        of_lines = lambda x: F.struct(
            F.size(x).alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
            F.size(F.filter(x, lambda y: y.rlike(r"^[\x20\x09-\x0D]*(?:[-*+•][\x20\x09]|[0-9]+[.)])"))).alias("n_listed_lines"),
            F.size(F.filter(x, lambda y: y.rlike(r"(?:\.\.\.|…)[\x20\x09-\x0D]*\z"))).alias("n_cut_lines"),
        )
        return F.struct(let(words, of_words).alias("w"), let(lines, of_lines).alias("l"), F.length(F.regexp_replace(t, WHITE, "")).alias("word_chars"), count(SYMBOLS).alias("n_symbols"), count(r"\p{L}[^\x20\x09-\x0D]*").alias("n_lettered_words"))

    def flat(x: Column) -> Column:
        parts = {"w": ("n_words", "n_stop_words", "n_repeat_words"), "l": ("n_lines", "n_dup_lines", "n_listed_lines", "n_cut_lines")}
        named = [(n, x[p][n]) for p, own in parts.items() for n in own] + [(n, x[n]) for n in ("word_chars", "n_symbols", "n_lettered_words")]
        return F.struct(*(c.cast("long").alias(n) for n, c in named))

    return let(let(F.coalesce(text, F.lit("")), of_text), flat)


def broken(of: Column, rule: Rule) -> Column:
    """Whether the counts ``of`` a text are out of a rule's bounds."""
    low = F.lit(False) if rule.least is None else 100 * of[rule.part] < rule.least * of[rule.whole]
    high = F.lit(False) if rule.most is None else 100 * of[rule.part] > rule.most * of[rule.whole]
    return low | high


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """``key``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, broken_rules of each row of ``docs``.

    Words are runs of other characters than space and tab to carriage return; lines without a word don't count.  base_failed:
    fewer than 20 words, or more than 30 % of them in repeated windows of 8.  kept: not so, and no rule is broken;
    broken_rules names them all, in the table's order.  A null text is an empty one (base_failed), a null key stays
    null, rows that repeat are judged each, an empty table gives no rows; other columns aren't read.  A whole text is
    one row's arrays, so it must fit a row; no rule depends on other rows, so there are no ties.
    """
    made = docs.select(F.col(key), counts(F.col(text), stop_words).alias("of"))
    of = F.col("of")
    failed = (of["n_words"] < LEAST_WORDS) | (100 * of["n_repeat_words"] > MOST_REPEATED * of["n_words"])
    hit = F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(broken(of, r), F.lit(r.name)) for r in rules)))
    passed = reduce(lambda a, r: a & ~broken(of, r), rules, ~failed)
    shown = [of[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return made.select(key, *shown, failed.alias("base_failed"), passed.alias("kept"), hit.alias("broken_rules"))


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """``docs`` without the rows that fail the base or break a rule; all columns stay, and nothing is joined."""
    of = counts(F.col(text))
    failed = lambda x: (x["n_words"] < LEAST_WORDS) | (100 * x["n_repeat_words"] > MOST_REPEATED * x["n_words"])
    return docs.filter(let(of, lambda x: reduce(lambda a, r: a & ~broken(x, r), rules, ~failed(x))))


def rule_sql(rule: Rule) -> str:
    """That a rule isn't broken, as SQL over columns with the counts' names."""
    low = [] if rule.least is None else [f"100 * {rule.part} >= {rule.least} * {rule.whole}"]
    high = [] if rule.most is None else [f"100 * {rule.part} <= {rule.most} * {rule.whole}"]
    return " AND ".join([*low, *high]) or "true"


def rules_sql(rules: Sequence[Rule] = RULES) -> str:
    """The condition of ``kept``, as SQL."""
    return " AND ".join([f"n_words >= {LEAST_WORDS}", f"100 * n_repeat_words <= {MOST_REPEATED} * n_words", *map(rule_sql, rules)])
