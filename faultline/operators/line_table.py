"""Reduction of logs that are tables of lines: a log's lines are rows of many tasks, in any order.

Lines are dealt to segments of a fixed number of lines, and what a line needs of its neighbours comes as a halo of copies from the
segments beside.  Ranks and lengths are sums in two levels: inside a segment, and over the segments of a log, a row for each.  So
no task holds a log, and no key of a shuffle has more rows than a segment and its halo.

A table of lines has log_id, line_no (from 0, without gaps) and line, each place once.  The results are those of ``reduction`` on the logs' texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.text import any_of, content, has_any, once, times
from faultline.operators import baselines, triage
from faultline.operators.reduction import ERROR_KEYWORDS, MARKER
from faultline.sources.storage import stored

SEGMENT = 1024
KEY = ("log_id", "seg")


def numbered_lines(rows: DataFrame, log: str, order: Sequence[str], span: Column) -> DataFrame:
    """``rows`` with line_no: the place of each in its log by ``order``.

    ``span`` rises with the order (a day of a time, say); places are counted inside spans, and sums of the spans before are added.
    """
    own = rows.withColumn("_span", span)
    sizes = own.groupBy(log, "_span").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(log).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(log, "_span").orderBy(*order)) - 1
    joined = own.withColumn("_in", inside).join(sizes.select(log, "_span", before.alias("_before")), [log, "_span"])
    return joined.withColumn("line_no", (F.col("_before") + F.col("_in")).cast("long")).drop("_span", "_in", "_before")


def with_halo(lines: DataFrame, width: int, segment: int = SEGMENT) -> DataFrame:
    """``lines`` by segment (seg), each with copies of the ``width`` lines before and after it; own tells its lines from copies."""
    at = lambda c: F.floor(c / segment)
    near = F.sequence(at(F.greatest(F.col("line_no") - width, F.lit(0))), at(F.col("line_no") + width))
    return lines.withColumn("seg", F.explode(near)).withColumn("own", F.col("seg") == at(F.col("line_no")))


def _flagged(lines: DataFrame, keywords: Sequence[str]) -> DataFrame:
    line = content(F.col("line"))
    return lines.select("log_id", F.col("line_no").cast("long").alias("line_no"), line.alias("line"), has_any(F.lower(line), keywords).alias("err"))


def context_windows(lines: DataFrame, width: int = 10, keywords: Sequence[str] = ERROR_KEYWORDS, segment: int = SEGMENT) -> DataFrame:
    """log_id, error_line, start, stop (past the end), lines: one window for each error line.  Only segments beside errors are gathered."""
    rows = with_halo(_flagged(lines, keywords), width, segment)
    held = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("line_no", "line", (F.col("own") & F.col("err")).alias("hit")))).alias("x"))  # a segment and its halo
    hits = held.select("log_id", "x", F.explode(F.transform(F.filter("x", lambda r: r["hit"]), lambda r: r["line_no"])).alias("error_line"))
    first = F.get("x", F.lit(0))["line_no"]
    start = F.greatest(F.col("error_line") - width, first)
    cut = F.slice("x", (start - first + 1).cast("int"), (F.col("error_line") + width + 1 - start).cast("int"))
    return hits.select("log_id", "error_line", start.alias("start"), cut.alias("x")).select("log_id", "error_line", "start", (F.col("start") + F.size("x")).alias("stop"), F.transform("x", lambda r: r["line"]).alias("lines"))


def reduced_lines(lines: DataFrame, max_lines: int = 500, width: int = 20, keywords: Sequence[str] = ERROR_KEYWORDS, segment: int = SEGMENT) -> DataFrame:
    """log_id, line_no, line, rank: lines within ``width`` of an error, the first ``max_lines``; without errors the last ``max_lines``.

    Segments' sizes and errors say first which segments can have such lines; only these are moved.
    """
    rows = _flagged(lines, keywords).withColumn("seg", F.floor(F.col("line_no") / segment))
    reach = -(-width // segment)
    # Segments that an error's window reaches are told by the error's own segment.
    facts = stored(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("err").alias("any")), "segments")
    of_log = Window.partitionBy("log_id")
    told = facts.select(*KEY, F.sum("n").over(of_log).alias("total"), F.max("any").over(of_log).alias("failed"), "any")
    beside = told.filter("any").select("log_id", F.explode(F.sequence(F.greatest(F.col("seg") - reach, F.lit(0)), F.col("seg") + reach)).alias("seg"), F.lit(0).cast("long").alias("tail")).distinct()
    last = told.filter("not failed").withColumn("tail", F.col("total") - max_lines).filter(F.col("seg") * segment + segment > F.col("tail")).select(*KEY, "tail")
    wanted = stored(beside.withColumn("near", F.lit(True)).unionByName(last.withColumn("near", F.lit(False))), "wanted-segments")
    moved = rows.join(wanted, list(KEY))
    tail = moved.filter("not near and line_no >= tail").select(*KEY, "line_no", "line")
    # Copies in a halo are of error lines alone.
    halo = with_halo(moved.filter("near").drop("seg"), width, segment).filter("own or err")
    around = Window.partitionBy(*KEY).orderBy("line_no").rangeBetween(-width, width)
    hit = halo.withColumn("hit", F.max("err").over(around)).filter("own and hit").select(*KEY, "line_no", "line")
    kept = stored(hit.unionByName(tail), "kept-lines")
    return first_lines(kept, max_lines).select("log_id", "line_no", "line", "rank")


def first_lines(rows: DataFrame, most: int, keys: Sequence[str] = ("log_id",)) -> DataFrame:
    """The first ``most`` of stored ``rows`` (keys, seg, line_no, ...) of each key, with their rank from 1.

    Sizes of segments say where a key's first rows are; only these segments are moved and ranked.
    """
    sizes = rows.groupBy(*keys, "seg").agg(F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy(*keys).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.select(*keys, "seg", before.alias("before")).filter(F.col("before") < most)
    ranked = rows.join(first, [*keys, "seg"]).withColumn("rank", (F.col("before") + F.row_number().over(Window.partitionBy(*keys, "seg").orderBy("line_no"))).cast("int"))
    return ranked.filter(F.col("rank") <= most).drop("before")


def truncated(rendered: DataFrame, max_tokens: int = 12000, segment: int = SEGMENT) -> DataFrame:
    """log_id, filtered: ordered lines (log_id, rank from 1, text) cut from the middle to a token budget.

    A line's place in the order of going follows from its log's number of lines; lengths of what is left are summed inside segments of that order
    and over them.  What stays of a log is within the budget, or ten lines, or the log was within it.
    """
    rows = rendered.select("log_id", "rank", content(F.col("text")).alias("text")).withColumn("seg", F.floor((F.col("rank") - 1) / segment))
    of_log = Window.partitionBy("log_id")
    facts = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("k"), F.sum(F.length("text") + 1).alias("size"))
    facts = facts.select(*KEY, F.sum("k").over(of_log).alias("n"), (F.sum("size").over(of_log) - 1).alias("total"))
    base = rows.join(stored(facts, "log-sizes"), list(KEY)).drop("seg")
    half, odd, pos = F.floor(F.col("n") / 2), F.col("n") % 2, F.col("rank") - 1
    after = pos - half
    goes = F.when(pos < half, 2 * (half - 1 - pos) + 2 + odd).otherwise(F.when(odd == 0, 2 * after + 1).otherwise(F.when(after == 0, 1).otherwise(2 * after)))
    base = stored(base.select("*", goes.cast("long").alias("goes"), (F.floor(F.col("total") / 4) > max_tokens).alias("over")).withColumn("seg", F.floor(F.col("goes") / segment)), "going")
    going = base.filter("over")
    sums = going.groupBy(*KEY).agg(F.sum(F.length("text") + 1).alias("size"))
    outer = F.coalesce(F.sum("size").over(of_log.orderBy(F.col("seg").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum(F.length("text") + 1).over(Window.partitionBy(*KEY).orderBy(F.col("goes").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = going.select(*KEY, "goes", "n", "total", within.alias("within")).join(sums.select(*KEY, outer.alias("outer")), list(KEY))
    fits = F.floor((F.col("outer") + F.col("within") + len(MARKER)) / 4) <= max_tokens  # once this line and all that go before it are gone
    least = left.groupBy("log_id").agg(F.min(F.when(fits, F.col("goes"))).alias("fits"), F.max("n").alias("n"), F.max("total").alias("total"))
    most = F.greatest(F.lit(0), F.col("n") - 10)
    whole = F.floor((F.col("total") + 1 + len(MARKER)) / 4) <= max_tokens
    least = least.select("log_id", F.when(whole, 0).otherwise(F.least(F.coalesce("fits", most), most)).alias("r"))
    # A log's cut is told to its segments, so that rows meet it by segment.
    cut = base.groupBy(*KEY).agg(F.max("over").alias("_over")).join(least, "log_id", "left").drop("_over")
    kept = base.join(stored(cut, "cuts"), list(KEY)).filter(F.col("r").isNull() | (F.col("goes") > F.col("r")))
    out = kept.groupBy("log_id").agg(F.max("over").alias("over"), F.max(F.floor(F.col("n") / 2)).alias("half"), F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("x"))
    text = lambda keep: F.transform(F.filter("x", keep), lambda s: s["text"])
    both = F.concat(text(lambda s: s["rank"] <= F.col("half")), F.array(F.lit(MARKER)), text(lambda s: s["rank"] > F.col("half")))
    return out.select("log_id", F.array_join(F.when(F.col("over"), both).otherwise(text(lambda s: F.lit(True))), "\n").alias("filtered"))


def smart_filter(lines: DataFrame, max_lines: int = 500, width: int = 20, max_tokens: int = 12000, keywords: Sequence[str] = ERROR_KEYWORDS, segment: int = SEGMENT) -> DataFrame:
    """log_id, filtered: the reduced lines as ``[Line N] text`` (N from 0), cut to the token budget."""
    kept = reduced_lines(lines, max_lines, width, keywords, segment)
    return truncated(kept.select("log_id", "rank", F.concat(F.lit("[Line "), F.col("line_no").cast("string"), F.lit("] "), "line").alias("text")), max_tokens, segment)


def triage_facts(lines: DataFrame, min_lines: int = 20, words: list[str] = triage.SIGNATURE_WORDS, segment: int = SEGMENT) -> DataFrame:
    """log_id, rule, signature, priority of every log, as triage has them of texts: what a line tells is summed over a log's lines.

    No rule's pattern reaches over a line's end.  A signature's first 20 lines are those of the log's first segments that have any.
    """
    c, low = content(F.col("line")), F.lower(content(F.col("line")))
    level = F.when(has_any(low, triage.HIGH_WORDS), 0).when(has_any(low, triage.MEDIUM_WORDS), 1).otherwise(2)
    told = lines.groupBy("log_id").agg(F.max(triage.is_cancelled(c)).alias("a"), F.max(triage.is_token_error(c)).alias("b"), F.count(F.lit(1)).alias("n"), F.min(level).alias("p"))
    rule = F.when(F.col("a"), triage.REASONS[0]).when(F.col("b"), triage.REASONS[1]).when(F.col("n") < min_lines, triage.REASONS[2])
    place = F.floor(F.col("line_no") / segment)
    errors = lines.filter(has_any(low, words)).select("log_id", place.alias("seg"), "line_no", triage.bare_line(c).alias("bare")).filter(F.length("bare") > 10)
    first = first_lines(stored(errors, "error-lines"), triage.SIGNATURE_LINES).groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.substring("bare", 1, triage.SIGNATURE_LENGTH).alias("t")))).alias("x"))  # 20 lines
    signed = first.select("log_id", triage.signature_of(F.transform("x", lambda r: r["t"])).alias("signature"))
    named = F.element_at(F.array(*map(F.lit, triage.PRIORITIES)), F.col("p") + 1)
    return told.join(signed, "log_id", "left").select("log_id", rule.alias("rule"), F.coalesce("signature", F.lit(triage.NO_ERRORS)).alias("signature"), named.alias("priority"))


def triaged(logs: DataFrame, lines: DataFrame, max_duplicates: int = 2, min_lines: int = 20, segment: int = SEGMENT) -> DataFrame:
    """Triage of logs (log_id, ord, repository; each log_id once) whose texts are a table of lines; a log without lines is an empty text."""
    facts = triage_facts(lines, min_lines, segment=segment)
    empty = F.when(F.lit(1 < min_lines), triage.REASONS[2])  # one line, and that is empty
    rule = F.when(F.col("priority").isNull(), empty).otherwise(F.col("rule"))
    joined = logs.select("log_id", "ord", "repository").join(facts, "log_id", "left")
    return triage.capped(joined.select("log_id", "ord", "repository", rule.alias("rule"), F.coalesce("signature", F.lit(triage.NO_ERRORS)).alias("signature"), F.coalesce("priority", F.lit(triage.PRIORITIES[-1])).alias("priority")), max_duplicates)


def baseline_facts(lines: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """log_id, regex_type, regex_lines, heuristic_type, heuristic_lines (numbers from 1) of every log, as the rule baselines have them of texts.

    Words are counted by line and summed.  Lines with a word of an error are stored once; the five of a log are the first of each score.
    """
    c, low = content(F.col("line")), F.lower(content(F.col("line")))
    hits = [F.max(c.rlike(any_of(p))).alias(f"r_{t}") for t, p in baselines.REGEX_TYPES.items()]
    counts = [F.sum(sum((times(low, w) for w in words), F.lit(0))).alias(t) for t, words in baselines.KEYWORDS.items()]
    told = lines.groupBy("log_id").agg(*hits, *counts)
    regex = F.coalesce(*(F.when(F.col(f"r_{t}"), t) for t in baselines.REGEX_TYPES), F.lit("unknown"))
    told = stored(told.select("log_id", regex.alias("regex_type"), baselines.heuristic_type(F.struct(*baselines.KEYWORDS)).alias("heuristic_type")), "types")
    likely = lines.filter(has_any(low, baselines.ERROR_WORDS + baselines.TRACE_WORDS)).select("log_id", "line_no", F.floor(F.col("line_no") / segment).alias("seg"), low.alias("low"))
    own = lambda kind, x: F.coalesce(*(F.when(kind == t, has_any(x, words)) for t, words in baselines.KEYWORDS.items()), F.lit(False))
    of_line = lambda kind: once(F.col("low"), lambda x: F.when(has_any(x, baselines.ERROR_WORDS), 3).otherwise(0) + F.when(own(kind, x), 2).otherwise(0) + F.when(has_any(x, baselines.TRACE_WORDS), 2).otherwise(0))
    # A log's type is told to its segments, so that lines meet it by segment.
    kinds = likely.select(*KEY).distinct().join(told.select("log_id", F.col("heuristic_type").alias("kind")), "log_id")
    scored = likely.join(stored(kinds, "types-of-segments"), list(KEY)).select(*KEY, "line_no", has_any(F.col("low"), baselines.ERROR_WORDS).alias("err"), of_line(F.col("kind")).alias("score"))
    scored = stored(scored, "scored-lines")
    by_score = first_lines(scored.filter("score >= 3"), 5, ("log_id", "score"))  # five of each score at most
    best = by_score.groupBy("log_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("line_no").alias("n")))), 1, 5).alias("x")).select("log_id", F.transform("x", lambda r: (r["n"] + 1).cast("int")).alias("heuristic_lines"))
    first = first_lines(scored.filter("err"), 5).groupBy("log_id").agg(F.array_sort(F.collect_list((F.col("line_no") + 1).cast("int"))).alias("regex_lines"))
    none = F.array().cast("array<int>")
    out = told.join(first, "log_id", "left").join(best, "log_id", "left")
    return out.select("log_id", "regex_type", F.coalesce("regex_lines", none).alias("regex_lines"), "heuristic_type", F.coalesce("heuristic_lines", none).alias("heuristic_lines"))
