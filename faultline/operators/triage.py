"""Triage of raw logs: noise rules, error signatures, a cap on duplicates, priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from faultline.functions.text import ANY_CASE, content, has_any, lines, once, strip

# Fixed values
CANCELLED = ["The operation was canceled", "Cancelling since a higher priority waiting request", "The runner has received a shutdown signal", "Error: The operation was canceled"]
TOKEN_ERRORS = ["Bad credentials", "401.*Unauthorized", "Resource not accessible by integration"]
SIGNATURE_WORDS = ["error", "failed", "exception", "fatal", "traceback"]
TIMESTAMP = r"\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2}[.\d]*Z?"
ANSI = r"\x1b\[[0-9;]*m"
ADDRESS = "0x[0-9a-fA-F]+"
SIGNATURE_LINES, SIGNATURE_LENGTH = 20, 200
HIGH_WORDS = ["traceback", "stack trace", "error:", "fatal"]
MEDIUM_WORDS = ["failed", "failure"]
FOLDING = "ſİıK"  # the letters beyond ASCII that match s, i, i, k where case doesn't count
REASONS = ("cancelled_run", "token_error", "too_short", "duplicate_error")
PRIORITIES = ("high", "medium", "low")
NO_ERRORS = "d41d8cd98f00"  # the signature of a log without error lines


def _folded(c: Column, low: Column) -> Column:
    """The text as patterns without regard to case see it: lower-cased, and the four letters beyond ASCII that fold to ASCII ones."""
    return F.when((F.length(c) == F.octet_length(c)) | ~has_any(c, list(FOLDING)), low).otherwise(F.lower(F.translate(c, FOLDING, "siik")))


def _has_literal(c: Column, folded: Column, patterns: list[str]) -> Column:
    """Whether a text has one of ``patterns``, without regard to case; a literal is looked for as such, ``a.*b`` only where both ends stand."""
    out = F.lit(False)
    for p in patterns:
        ends = p.lower().split(".*")
        both = folded.contains(ends[0])
        for end in ends[1:]:
            both = both & folded.contains(end)
        out = out | (both if len(ends) == 1 else both & c.rlike(ANY_CASE + p))
    return out


def is_cancelled(c: Column) -> Column:
    c = content(c)
    return once(_folded(c, F.lower(c)), lambda folded: _has_literal(c, folded, CANCELLED))


def is_token_error(c: Column) -> Column:
    c = content(c)
    return once(_folded(c, F.lower(c)), lambda folded: _has_literal(c, folded, TOKEN_ERRORS))


def is_too_short(c: Column, min_lines: int = 20) -> Column:
    c = content(c)
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1 < min_lines


def bare_line(x: Column) -> Column:
    """A line without times, colours and addresses."""
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, TIMESTAMP, ""), ANSI, ""), ADDRESS, "0xADDR"))


def signature_of(kept: Column) -> Column:
    """12 hex digits of the md5 of an array of lines."""
    return F.substring(F.md5(F.array_join(kept, "\n").cast("binary")), 1, 12)


def _signature(c: Column, low: Column, words: list[str]) -> Column:
    errors = F.array_compact(F.zip_with(lines(low), lines(c), lambda x, own: F.when(has_any(x, words), own)))
    kept = F.slice(F.filter(F.transform(errors, bare_line), lambda x: F.length(x) > 10), 1, SIGNATURE_LINES)
    return F.when(has_any(low, words), signature_of(F.transform(kept, lambda x: F.substring(x, 1, SIGNATURE_LENGTH)))).otherwise(NO_ERRORS)


def error_signature(c: Column, words: list[str] = SIGNATURE_WORDS) -> Column:
    """12 hex digits of the md5 of the first 20 error lines without times, colours and addresses."""
    return once(F.lower(content(c)), lambda low: _signature(c, low, words))


def _priority(low: Column) -> Column:
    return F.when(has_any(low, HIGH_WORDS), "high").when(has_any(low, MEDIUM_WORDS), "medium").otherwise("low")


def priority(c: Column) -> Column:
    return once(F.lower(content(c)), _priority)


def _facts(c: Column, min_lines: int, words: list[str]) -> Column:
    """rule, signature and priority of a log, whose text is lower-cased once."""
    c = content(c)

    def rule_of(folded: Column) -> Column:
        return F.when(_has_literal(c, folded, CANCELLED), REASONS[0]).when(_has_literal(c, folded, TOKEN_ERRORS), REASONS[1]).when(is_too_short(c, min_lines), REASONS[2])

    def of(low: Column) -> Column:
        return F.struct(once(_folded(c, low), rule_of).alias("rule"), _signature(c, low, words).alias("signature"), _priority(low).alias("priority"))

    return once(F.lower(c), of)


def triage(logs: DataFrame, max_duplicates: int = 2, min_lines: int = 20, words: list[str] = SIGNATURE_WORDS, cap_empty_signature: bool = True) -> DataFrame:
    """log_id, ord, repository, reason (null if kept), signature, priority of every log.

    Rules hold in order; the cap counts, in order of arrival, the rows that no earlier rule removed.  A row in is a row out, so
    rows that repeat one another count each.  The content is read once and isn't moved.  The cap ranks parts of a repository's
    like errors first, and then only each part's first rows, so a repository full of them is no single task.
    """
    facts = logs.select("log_id", "ord", "repository", _facts(F.col("log_content"), min_lines, words).alias("f")).select("log_id", "ord", "repository", "f.*")
    return capped(facts, max_duplicates, cap_empty_signature)


def capped(facts: DataFrame, max_duplicates: int = 2, cap_empty_signature: bool = True) -> DataFrame:
    """The reason of each row of facts (log_id, ord, repository, rule, signature, priority): its rule, or that it repeats others' errors too often."""
    counted = F.col("rule").isNull() if cap_empty_signature else F.col("rule").isNull() & (F.col("signature") != NO_ERRORS)
    facts = facts.withColumn("counted", counted).withColumn("part", F.pmod(F.xxhash64("ord", "log_id"), F.lit(64)))
    ranked = lambda df, name: df.withColumn(name, F.row_number().over(Window.partitionBy("repository", "signature", "counted", "part").orderBy("ord", "log_id")))
    # The first rows of a group are among the first of each of its parts; these meet in one part.
    local = ranked(facts, "first").withColumn("part", F.when(F.col("counted") & (F.col("first") <= max_duplicates), F.lit(-1)).otherwise(F.col("part")))
    over = F.col("counted") & ((F.col("part") >= 0) | (F.col("rank") > max_duplicates))
    return ranked(local, "rank").select("log_id", "ord", "repository", F.coalesce("rule", F.when(over, REASONS[3])).alias("reason"), "signature", "priority")


def kept_in_order(triaged: DataFrame) -> DataFrame:
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    return triaged.filter("reason is null").orderBy(rank, "ord")


def removed(triaged: DataFrame) -> DataFrame:
    """log_id, reason, repository, and the signature of duplicates."""
    return triaged.filter("reason is not null").select("log_id", "reason", "repository", F.when(F.col("reason") == REASONS[3], F.col("signature")).alias("signature"))


def _levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("priority", p, 0) for p in PRIORITIES], "kind string, name string, n long")


def report(triaged: DataFrame) -> DataFrame:
    """kind, name, n: removed by reason, and kept by each priority (with zeros); the logs are gone through once."""
    counted = triaged.groupBy("reason", F.when(F.col("reason").isNull(), F.col("priority")).alias("priority")).agg(F.count(F.lit(1)).alias("n"))
    named = counted.select(F.when(F.col("reason").isNull(), "priority").otherwise("reason").alias("kind"), F.coalesce("reason", "priority").alias("name"), "n")
    return named.unionByName(_levels(triaged.sparkSession)).groupBy("kind", "name").agg(F.sum("n").alias("n"))


def write_triaged(triaged: DataFrame, path: str) -> DataFrame:
    """Write kept and removed logs to ``path`` by outcome (kept, removed), and give their :func:`report`, which is counted as they pass."""
    seen, reason = Observation(), F.col("reason")
    counts = [F.count_if(reason == r).alias(r) for r in REASONS] + [F.count_if(reason.isNull() & (F.col("priority") == p)).alias(p) for p in PRIORITIES]
    outcome = F.when(reason.isNull(), "kept").otherwise("removed")
    triaged.withColumn("outcome", outcome).observe(seen, *counts).write.partitionBy("outcome").parquet(path)
    found = [("reason", r, seen.get[r]) for r in REASONS if seen.get[r]] + [("priority", p, seen.get[p]) for p in PRIORITIES]
    return triaged.sparkSession.createDataFrame(found, "kind string, name string, n long")
