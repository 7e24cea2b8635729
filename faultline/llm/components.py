"""Connected components of a table of links, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored


def connected(links: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """node, component (the least node that can be reached) of every node of ``links`` (pairs of integers).

    Loops and repeated links change nothing; links with a null end are left out; no links give no rows.  Each
    step is two aggregations and joins, written to the shared folder; the number of steps grows with the logarithm of the
    number of nodes, not with the length of chains.
    """
    edges = links.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    nodes = stored(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "nodes")
    edges = stored(edges.filter("u > v"), "edges")
    seen = None
    while True:
        # Large star: every greater neighbour gets a link to the least of the neighbourhood.
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: lesser neighbours, and the node, get a link to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        before, edges = edges, stored(small.filter("u > v").distinct(), "edges")
        discard(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
