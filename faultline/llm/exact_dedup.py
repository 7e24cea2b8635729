"""Exact duplicates by deterministic block naming (operator 10).

A normalised text is cut into blocks of a fixed number of bytes.  Distinct blocks are sorted and get
their places as names; then adjacent names are paired, distinct pairs are sorted and named, and so on until each
document has one name.  Names stand one to one for contents at each level, so two documents have the same
(depth, name) if and only if their texts are equal: no digest decides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import hinted, let, scratch, stored

BLOCK_BYTES = 2048
#: Runs of these six characters count as one space.
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def named(distinct: DataFrame, by: list[str], what: str) -> DataFrame:
    """``distinct`` rows and their names: places 0, 1, 2, ... in the order of ``by``, whatever the number of partitions.

    Ranges of rows are sorted; a row's name is its place there and the number of rows in the ranges before.
    """
    placed = stored(distinct.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), what)
    ranges = placed.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # a row for each range
    out = placed.join(F.broadcast(ranges), F.shiftright("at", 33) == F.col("range"))
    return out.select(*distinct.columns, (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("name"))


def _block_names(blocks: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """row, pos and the name of each block.

    Blocks are sorted by a digest, and by themselves where two distinct blocks share one: the bytes are moved once, to find
    the distinct ones, and again only if there are such blocks.
    """
    keyed = blocks.withColumn("h", digest(F.col("block")))
    distinct = keyed.groupBy("h", "block").agg(F.lit(1).alias("one"))
    digests = stored(distinct.select("h"), "digests")
    if digests.groupBy("h").count().filter("count > 1").isEmpty():
        return keyed.select("row", "pos", "h").join(named(digests, ["h"], "block-names"), "h").select("row", "pos", "name")
    names = named(distinct.select("h", "block"), ["h", "block"], "block-names").select("block", "name")
    return keyed.select("row", "pos", "block").join(names, "block").select("row", "pos", "name")


def document_names(rows: DataFrame, block_bytes: int = BLOCK_BYTES, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One identity for each row: ``rows`` has row (unique, the same each time it is read) and text (normalised); returns row, depth, name."""

    def cut(raw: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil(F.octet_length(raw) / block_bytes).cast("int") - 1)
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * block_bytes + 1, F.lit(block_bytes)))

    blocks = rows.select("row", F.posexplode(let(F.col("text").cast("binary"), cut)).alias("pos", "block"))
    level, depth, done = stored(_block_names(blocks, digest), "names"), 0, None
    while True:
        longer = level.filter("pos > 0").select("row").distinct()
        if longer.isEmpty():
            final = level.select("row", F.lit(depth).alias("depth"), "name")
            return final if done is None else done.unionByName(final)
        with scratch():
            # A row whose only name is at place 0 is done at this depth.
            of_row = level.groupBy("row", F.floor(F.col("pos") / 2).alias("pos")).agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
            pairs = stored(of_row, f"pairs-{depth}")
            more = pairs.filter("pos > 0 or b >= 0").select("row").distinct()
            ended = pairs.filter("pos = 0 and b < 0").join(more, "row", "left_anti").select("row", F.lit(depth).alias("depth"), F.col("a").alias("name"))
            ended = stored(ended, f"ended-{depth}", kept=True)
            done = ended if done is None else done.unionByName(ended)
            going = pairs.join(more, "row", "left_semi")
            names = named(going.select("a", "b").distinct(), ["a", "b"], f"pair-names-{depth}")
            level = stored(going.join(names, ["a", "b"]).select("row", "pos", "name"), f"names-{depth}", kept=True)
        depth += 1


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """The group of equal texts of every row: ``key``, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after each run of white space (space, tab to carriage return) became one space; a null
    text is an empty one.  The smallest ``key`` of a group stays (null keys only if there is no other); rows
    that repeat a key are rows of their own, and all those with the kept key are marked kept.  An empty table
    gives no rows; other columns aren't read.
    """
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), normalised(F.col(text)).alias("text")), "rows")  # ids are given once
    with scratch():
        named_rows = document_names(rows.select("row", "text"), block_bytes, digest)
        found = stored(named_rows.join(rows.select("row", "key"), "row"), "named", kept=True)
    groups = stored(found.groupBy("depth", "name").agg(F.min("key").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    of_row = found.join(groups, ["depth", "name"]).select("row", "keep_id", "group_size")
    facts = rows.select("row", "key", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    return facts.join(of_row, "row").select(F.col("key").alias(key), "keep_id", "group_size", F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text an equal text with a smaller key has; all columns stay."""
    with scratch():
        kept = stored(exact_groups(docs, key, text).filter("kept").select(F.col(key).alias("_kept")).distinct(), "kept", kept=True)
    return docs.join(hinted(kept), docs[key].eqNullSafe(kept["_kept"]), "left_semi")
