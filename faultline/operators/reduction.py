"""Reduction of logs to the lines around errors, under a line and a token budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.text import any_of, content, has_any, lines

# Fixed values
ERROR_KEYWORDS = ["error", "failed", "failure", "exception", "fatal", "critical", "panic", "traceback", "stack trace", "npm err!", "gradle failed", "maven error", "pytest failed"]
DETECTED = [r"(?i:error:?\s)", r"(?i:exception:?\s)", r"(?i:failed:?\s)", r"(?i:failure:?\s)", r"(?i:fatal:?\s)", r"(?i:traceback)", "npm ERR!", "FAILED", "BUILD FAILED", "Test.*failed"]
MARKER = "... [truncated] ..."


def log_lines(logs: DataFrame) -> DataFrame:
    """log_id, line_no (from 0), line."""
    return logs.select("log_id", F.posexplode(lines(F.col("log_content"))).alias("line_no", "line"))


def error_positions(c: Column, keywords: Sequence[str] = ERROR_KEYWORDS) -> Column:
    """Indices (from 0) of the lines that contain a keyword."""
    found = F.transform(lines(c), lambda x, i: F.when(has_any(F.lower(x), keywords), i))
    return F.array_compact(found)


def detected_lines(c: Column) -> Column:
    """Numbers (from 1) of the lines that look like errors."""
    return F.array_compact(F.transform(lines(c), lambda x, i: F.when(x.rlike(any_of(DETECTED, "(?d)")), i + 1)))


def context_windows(logs: DataFrame, width: int = 10, keywords: Sequence[str] = ERROR_KEYWORDS) -> DataFrame:
    """log_id, error_line, start, stop (past the end), lines: one window for each error line."""
    base = logs.select("log_id", lines(F.col("log_content")).alias("lines"), F.explode(error_positions(F.col("log_content"), keywords)).alias("error_line"))
    start, stop = F.greatest(F.lit(0), F.col("error_line") - width), F.least(F.size("lines"), F.col("error_line") + width + 1)
    return base.select("log_id", "error_line", start.alias("start"), stop.alias("stop"), F.slice("lines", start + 1, stop - start).alias("lines"))


def reduced_lines(logs: DataFrame, max_lines: int | Column = 500, width: int = 20, keywords: Sequence[str] = ERROR_KEYWORDS, keys: Sequence[str] = ("log_id",)) -> DataFrame:
    """keys, line_no, line, rank: lines within ``width`` of an error, the first ``max_lines``; without errors the last ``max_lines``.

    Only lines that can stay are exploded.  max_lines may be a column (null: no limit).
    """
    most = F.lit(max_lines) if isinstance(max_lines, int) else max_lines
    base = logs.select(*keys, F.col("log_content"), most.alias("most"), error_positions(F.col("log_content"), keywords).alias("errors"))
    base = base.select(*keys, lines(F.col("log_content")).alias("lines"), "most", "errors")
    n = F.size("lines")
    near = F.array_distinct(F.flatten(F.transform("errors", lambda e: F.sequence(F.greatest(e - width, F.lit(0)), F.least(e + width, n - 1)))))
    tail = F.sequence(F.when(F.col("most").isNull(), 0).otherwise(F.greatest(n - F.col("most"), F.lit(0))), n - 1)
    places = F.when(F.size("errors") > 0, near).otherwise(tail)  # windows of ascending errors ascend
    kept = F.when(F.col("most").isNull(), places).otherwise(F.slice(places, 1, F.col("most")))
    rows = base.select(*keys, F.explode(F.transform(kept, lambda p, i: F.struct(p.alias("line_no"), F.get("lines", p).alias("line"), (i + 1).alias("rank")))).alias("x"))
    return rows.select(*keys, "x.*")


def truncated(rendered: DataFrame, keys: Sequence[str] = ("log_id",), max_tokens: int = 12000) -> DataFrame:
    """Middle-out cut of ordered lines (keys, rank from 1, text) to a token budget; returns keys and filtered.

    Over the budget, lines go alternately from the middle until head, marker and tail fit, but five of each half stay.  The r
    lines that go first are known in advance, so the cut is a running sum in order of going.
    """
    by = Window.partitionBy(*keys)
    n, pos = F.count(F.lit(1)).over(by), F.col("rank") - 1
    base = rendered.select(*keys, "rank", "text").withColumn("n", n).withColumn("total", F.sum(F.length("text") + 1).over(by) - 1)
    half, odd = F.floor(F.col("n") / 2), F.col("n") % 2
    j_tail = pos - half
    order = F.when(pos < half, 2 * (half - 1 - pos) + 2 + odd).otherwise(F.when(odd == 0, 2 * j_tail + 1).otherwise(F.when(j_tail == 0, 1).otherwise(2 * j_tail)))
    base = base.withColumn("goes", order)
    later = by.orderBy(F.col("goes").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # Length once this line and all before it in the order of going are gone.
    base = base.withColumn("left", F.coalesce(F.sum(F.length("text") + 1).over(later), F.lit(0)) + len(MARKER))
    most = F.greatest(F.lit(0), F.col("n") - 10)
    whole = (F.col("total") + 1 + len(MARKER))  # nothing gone, marker in
    fits = F.min(F.when(F.floor(F.col("left") / 4) <= max_tokens, F.col("goes"))).over(by)
    r = F.when(F.floor(whole / 4) <= max_tokens, 0).otherwise(F.least(F.coalesce(fits, most), most))
    base = base.withColumn("r", r).withColumn("over", F.floor(F.col("total") / 4) > max_tokens)
    kept = base.filter(~F.col("over") | (F.col("goes") > F.col("r"))).select(*keys, "rank", "text", "over", F.floor(F.col("n") / 2).alias("half"))
    out = kept.groupBy(*keys).agg(F.max("over").alias("over"), F.max("half").alias("half"), F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("x"))
    text = lambda keep: F.transform(F.filter("x", keep), lambda s: s["text"])
    cut = F.concat(text(lambda s: s["rank"] <= F.col("half")), F.array(F.lit(MARKER)), text(lambda s: s["rank"] > F.col("half")))
    return out.select(*keys, F.array_join(F.when(F.col("over"), cut).otherwise(text(lambda s: F.lit(True))), "\n").alias("filtered"))


def smart_filter(logs: DataFrame, max_lines: int = 500, width: int = 20, max_tokens: int = 12000, keywords: Sequence[str] = ERROR_KEYWORDS) -> DataFrame:
    """log_id, filtered: the reduced lines as ``[Line N] text`` (N from 0), cut to the token budget."""
    kept = reduced_lines(logs, max_lines, width, keywords)
    return truncated(kept.select("log_id", "rank", F.concat(F.lit("[Line "), F.col("line_no").cast("string"), F.lit("] "), F.col("line")).alias("text")), max_tokens=max_tokens)


def ablation(logs: DataFrame, limits: dict[str, int | None], width: int = 20, keywords: Sequence[str] = ERROR_KEYWORDS) -> DataFrame:
    """strategy, logs, kept_lines, kept_tokens for each limit on lines (None: the whole log)."""
    strategies = logs.sparkSession.createDataFrame([(k, v) for k, v in limits.items()], "strategy string, most int")
    grid = logs.select("log_id", "log_content").crossJoin(F.broadcast(strategies))  # a handful of strategies
    cut = reduced_lines(grid.filter("most is not null"), F.col("most"), width, keywords, ("strategy", "log_id"))
    per_log = cut.groupBy("strategy", "log_id").agg(F.count(F.lit(1)).alias("k"), (F.sum(F.length("line") + F.length(F.concat(F.lit("[Line "), F.col("line_no").cast("string"), F.lit("] ")))) + F.count(F.lit(1)) - 1).alias("c"))
    whole = grid.filter("most is null").select("strategy", "log_id", F.size(lines(F.col("log_content"))).cast("long").alias("k"), F.length(content(F.col("log_content"))).cast("long").alias("c"))
    return per_log.unionByName(whole).groupBy("strategy").agg(F.count(F.lit(1)).alias("logs"), F.sum("k").alias("kept_lines"), F.sum(F.floor(F.col("c") / 4)).alias("kept_tokens"))
