"""Rule baselines and error types of logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.text import any_of, content, has_any, lines, once, times

# Fixed values
FIRST_MATCH = {
    "dependency_error": ["dependency", "package", "module not found", "import error"],
    "test_failure": ["test failed", "assertion", "expected"],
    "timeout": ["timeout", "timed out"],
    "permission_denied": ["permission denied", "access denied"],
    "syntax_error": ["syntax error", "parse error"],
    "network_error": ["connection", "network", "dns"],
    "build_configuration": ["build.gradle", "pom.xml", "package.json"],
}
REGEX_TYPES = {
    "dependency_error": ["ModuleNotFoundError", "ImportError", "package.*not found"],
    "test_failure": ["FAILED.*test", "AssertionError", "Test.*failed"],
    "build_configuration": ["build.*failed", "gradle.*error", "maven.*error"],
    "timeout": ["timeout", "timed out"],
    "permission_denied": ["permission denied", "access denied"],
}
KEYWORDS = {
    "dependency_error": ["module", "import", "package", "dependency", "requirements"],
    "test_failure": ["test", "assertion", "expected", "actual", "junit"],
    "build_configuration": ["gradle", "maven", "npm", "build.gradle", "pom.xml"],
    "timeout": ["timeout", "timed out", "time limit"],
    "permission_denied": ["permission", "access denied", "forbidden"],
    "syntax_error": ["syntax", "parse", "unexpected token"],
    "network_error": ["connection", "network", "dns", "host"],
}
ERROR_WORDS = ["error", "failed", "exception", "fatal"]
TRACE_WORDS = ["traceback", "stack trace"]
TOOLS = {
    "npm": r"\bnpm\b",
    "maven": r"\bmaven\b|\bpom\.xml\b",
    "pip": r"\bpip\b|\brequirements\.txt\b",
    "docker": r"\bdocker\b|\bDockerfile\b",
    "gradle": r"\bgradle\b|\bbuild\.gradle\b",
    "pytest": r"\bpytest\b",
    "jest": r"\bjest\b",
    "github_actions": r"github actions|\bworkflow\b",
}


def _first(cases: list[tuple[Column, str]], other: str = "unknown") -> Column:
    return F.coalesce(*[F.when(c, F.lit(v)) for c, v in cases], F.lit(other))


def first_match_type(c: Column) -> Column:
    low = F.lower(content(c))
    return _first([(has_any(low, w), t) for t, w in FIRST_MATCH.items()])


def tool_mentions(c: Column, tools: dict[str, str] = TOOLS) -> Column:
    """The tools whose patterns a text has, in their fixed order."""
    return F.array_compact(F.array(*[F.when(content(c).rlike("(?iudU)" + p), F.lit(t)) for t, p in tools.items()]))


def regex_type(c: Column) -> Column:
    return _first([(content(c).rlike(any_of(p)), t) for t, p in REGEX_TYPES.items()])


def regex_lines(c: Column) -> Column:
    """The first five numbers (from 1) of lines with an error word."""
    return F.slice(F.array_compact(F.transform(lines(F.lower(content(c))), lambda x, i: F.when(has_any(x, ERROR_WORDS), i + 1))), 1, 5)


def heuristic_counts(c: Column, keywords: dict[str, list[str]] = KEYWORDS) -> Column:
    """Keyword counts by type, as a struct in the declared order."""
    return once(F.lower(content(c)), lambda low: F.struct(*[sum((times(low, w) for w in words), F.lit(0)).cast("long").alias(t) for t, words in keywords.items()]))


def heuristic_type(counts: Column, keywords: dict[str, list[str]] = KEYWORDS) -> Column:
    """The type with the most counts, the first declared of equals; unknown without any."""

    def named(n: Column) -> Column:
        return once(F.greatest(*[n[t] for t in keywords]), lambda most: F.when(most == 0, "unknown").otherwise(_first([(n[t] == most, t) for t in keywords])))

    return once(counts, named)


def heuristic_lines(c: Column, kind: Column, keywords: dict[str, list[str]] = KEYWORDS) -> Column:
    """The five lines (from 1) with the highest scores of 3 or more; equal scores in order."""

    def score(low: Column) -> Column:
        own = F.coalesce(*(F.when(kind == t, has_any(low, words)) for t, words in keywords.items()), F.lit(False))
        return F.when(has_any(low, ERROR_WORDS), 3).otherwise(0) + F.when(own, 2).otherwise(0) + F.when(has_any(low, TRACE_WORDS), 2).otherwise(0)

    # Keywords alone don't reach 3, so only lines with a word of an error or a trace are scored.
    likely = F.filter(F.transform(lines(F.lower(content(c))), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("n"))), lambda r: has_any(r["x"], ERROR_WORDS + TRACE_WORDS))
    scored = F.transform(likely, lambda r: F.struct((-score(r["x"])).alias("s"), r["n"].alias("n")))
    return F.transform(F.slice(F.array_sort(F.filter(scored, lambda x: x["s"] <= -3)), 1, 5), lambda x: x["n"])
