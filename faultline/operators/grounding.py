"""Grounding: does the cited evidence stand in the log?"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from faultline.functions.text import lines, once, strip

RATIO = 0.75
THRESHOLD = 0.8


def line_map(filtered: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """log_id, line_number, content: from ``[Line N] text`` markers (the last of a number wins), else lines from 0.

    A number too long for a long is no marker.  wanted (log_id, line_number): only these lines are kept.  Each log's lines are
    sorted out in its own row; none is shuffled.
    """
    marked = r"(?d)^\[Line (\d+)\]\s?(.*)"
    number = lambda x: F.when(x.rlike(marked), F.regexp_extract(x, marked, 1)).try_cast("bigint")

    def numbered(plain: Column) -> Column:
        rows = F.array_sort(F.filter(F.transform(plain, lambda x, i: F.struct(number(x).alias("line_number"), i.alias("at"), F.regexp_extract(x, marked, 2).alias("content"))), lambda r: r["line_number"].isNotNull()))
        last = once(rows, lambda sorted_rows: F.filter(sorted_rows, lambda r, i: ~r["line_number"].eqNullSafe(F.get(sorted_rows, i + 1)["line_number"])))
        bare = F.transform(plain, lambda x, i: F.struct(i.cast("bigint").alias("line_number"), i.alias("at"), x.alias("content")))
        return once(last, lambda found: F.when(F.size(found) > 0, found).otherwise(bare))

    base = filtered
    if wanted is not None:
        numbers = wanted.groupBy(F.col("log_id").alias("_log")).agg(F.collect_set(F.col("line_number").cast("bigint")).alias("_wanted"))  # a log's own citations
        base = filtered.join(numbers, F.col("log_id") == F.col("_log"))
    rows = once(lines(F.col("filtered")), numbered)
    kept = rows if wanted is None else F.filter(rows, lambda r: F.array_contains("_wanted", r["line_number"]))
    return base.select("log_id", F.explode(kept).alias("r")).select("log_id", "r.line_number", "r.content")


@F.pandas_udf(BooleanType())
def _alike(cited: pd.Series, actual: pd.Series) -> pd.Series:
    """Whether two texts are alike; nulls aren't compared."""
    return pd.Series([a is not None and SequenceMatcher(None, a, b).ratio() >= RATIO for a, b in zip(cited, actual, strict=True)], dtype=bool)


def verified(evidence: DataFrame, numbered: DataFrame, fuzzy: bool = True) -> DataFrame:
    """evidence (log_id, evidence_no, line_number, cited) with actual, blank, exact, verified.

    A citation is verified if it stands in the line it cites, or is alike by Ratcliff and Obershelp; only citations that their
    lengths allow to be alike are compared.  A blank citation is never verified.
    """
    joined = evidence.join(numbered, ["log_id", "line_number"], "left").withColumn("actual", F.coalesce("content", F.lit(""))).drop("content")
    cited = strip(F.coalesce("cited", F.lit("")))
    base = joined.withColumn("c", cited).withColumn("a", strip(F.col("actual")))
    base = base.withColumn("blank", F.col("c") == "").withColumn("exact", (F.col("c") != "") & F.contains("actual", "c"))
    la, lb = F.length("c"), F.length("a")
    may = ~F.col("exact") & ~F.col("blank") & (2 * F.least(la, lb) >= RATIO * (la + lb))
    if not fuzzy:
        return base.withColumn("verified", F.col("exact")).drop("c", "a")
    return base.withColumn("verified", F.col("exact") | _alike(F.when(may, F.col("c")), F.when(may, F.col("a")))).drop("c", "a")


def scores(logs: DataFrame, checked: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """log_id, score, flagged, confidence: the share of verified citations; no evidence scores 0 and isn't flagged."""
    share = checked.groupBy("log_id").agg((F.count_if("verified") / F.count(F.lit(1))).alias("share"))
    out = logs.select("log_id", "raw_confidence").join(share, "log_id", "left")
    return out.select("log_id", F.coalesce("share", F.lit(0.0)).alias("score"), F.coalesce(F.col("share") < threshold, F.lit(False)).alias("flagged"), (F.col("raw_confidence") * F.coalesce("share", F.lit(0.0))).alias("confidence"))
