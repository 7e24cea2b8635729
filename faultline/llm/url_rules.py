"""URL filters by association rules (operator 9).

Given rules decide first.  Other urls are judged by rules that Spark's FP-growth mines from labelled urls: combinations of url
tokens that go with a label often enough and surely enough.  They are matched by an inverted index from tokens to rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import UPPER, maybe_broadcast, stored

#: (verdict, host, path); a rule fits its host and all subdomains, and paths that start with its path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SUPPORT = 0.01
CONFIDENCE = 0.6
#: Labelled urls that a rule rests on at least.
LEAST = 3
BAD, GOOD = "label:block", "label:allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for what has no ``://``."""
    whole = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(whole, pattern, 1), UPPER, UPPER.lower()), F.regexp_extract(whole, pattern, 2)


def given_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    found = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    ]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,verdict:string>")


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a url: host suffixes of one to three labels, path segments (digits folded to one #), file ending, names in the query."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffix = [F.when((n >= k) & (host != ""), F.concat(F.lit(f"host{k}:"), F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), "."))) for k in (1, 2, 3)]
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "#")))
    ending = F.regexp_extract(path, r"\.([A-Za-z]{1,5})$", 1)
    query = F.regexp_extract_all(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), 1)
    return F.array_distinct(F.concat(F.array_compact(F.array(*suffix, F.when(ending != "", F.concat(F.lit("ending:"), ending)))), parts, F.transform(query, lambda x: F.concat(F.lit("query:"), x))))


def mine_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """rule_id, tokens, verdict, confidence, support from ``labelled`` (tokens, bad boolean); a null label isn't used.

    A rule is kept if its support, confidence and number of urls reach the limits, it is surer than the empty rule (the verdict's share of all
    urls: a lift above 1), and no rule of fewer of its tokens with the same verdict is as sure.
    """
    baskets = labelled.filter(F.col("bad").isNotNull()).select(F.concat(F.col("tokens"), F.array(F.when(F.col("bad"), F.lit(BAD)).otherwise(F.lit(GOOD)))).alias("items"))
    n = baskets.count()
    if n == 0:
        return labelled.sparkSession.createDataFrame([], "rule_id string, tokens array<string>, verdict string, confidence double, support double")
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, least / n)), minConfidence=confidence).fit(baskets).associationRules
    found = found.filter(F.element_at("consequent", 1).isin(BAD, GOOD) & (F.round(F.col("support") * n) >= least) & (F.col("lift") > 1))
    rules = found.select(F.array_sort("antecedent").alias("tokens"), F.when(F.element_at("consequent", 1) == BAD, "block").otherwise("allow").alias("verdict"), "confidence", "support")
    rules = stored(rules.withColumn("rule_id", F.array_join("tokens", " ")), "rules")
    # Pruning by the index: shorter rules are found among a rule's tokens by their tokens.
    short = rules.select(F.col("rule_id").alias("s"), "verdict", F.col("confidence").alias("c"), F.size("tokens").alias("k"), F.explode("tokens").alias("token"))
    long = rules.select("rule_id", "verdict", "confidence", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    covered = long.join(short, ["token", "verdict"]).filter("k < n and c >= confidence").groupBy("rule_id", "verdict", "s", "k").count().filter("count = k").select("rule_id", "verdict").distinct()
    return rules.join(covered, ["rule_id", "verdict"], "left_anti").select("rule_id", "tokens", "verdict", "confidence", "support")


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST, key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, host, path, rule, verdict, mined_rule of every page.

    labelled: url and bad (boolean).  A given rule decides (the longest that fits); else the mined rule with the most
    confidence, then support, then tokens, then the least id (mined_rule says which); else the verdict is allow.  Null urls and
    those without ``://`` have no host and no path and fit no given rule.  Repeated rows are judged each; an empty table gives
    no rows; other columns aren't read.
    """

    def prepared(df, column, *more):
        host, path = host_and_path(F.col(column))
        return df.select(*more, host.alias("host"), path.alias("path"), F.col(column).alias("url")).select(*more, "host", "path", url_tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens"))

    mined = stored(mine_rules(prepared(labelled, "url", "bad"), support, confidence, least), "mined")
    base = stored(prepared(pages.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(url).alias("u")), "u", "row", "key"), "urls")  # ids are given once
    index = mined.select("rule_id", "verdict", "confidence", "support", F.size("tokens").alias("k"), F.explode("tokens").alias("token"))
    size = index.agg(F.sum(F.length("rule_id") + F.length("token") + 64)).first()[0] or 0
    met = base.select("row", F.explode("tokens").alias("token")).join(maybe_broadcast(index, size), "token")
    full = met.groupBy("row", "rule_id", "verdict", "confidence", "support", "k").count().filter("count = k")
    best = full.groupBy("row").agg(F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), (-F.col("k")).alias("k"), "rule_id", "verdict")).alias("best"))
    out = base.withColumn("given", given_rule(F.col("host"), F.col("path"), rules)).select("row", "key", "host", "path", "given").join(best, "row", "left")
    return out.select(F.col("key").alias(key), "host", "path", F.col("given.rule").alias("rule"), F.coalesce("given.verdict", "best.verdict", F.lit("allow")).alias("verdict"), F.when(F.col("given").isNull(), F.col("best.rule_id")).alias("mined_rule"))
