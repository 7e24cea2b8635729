"""Quality classifier (operator 1): a modified Kneser-Ney model of trusted text, and limits on perplexity by language.

The model is fitted on the tokens of four in five of all trusted rows.  Documents get their perplexity by joins of their blocks'
distinct n-grams with the model's sharded tables.  Limits are quantiles of the perplexities of all other trusted rows, by language, so
that a language that the model finds harder isn't judged by another's measure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ngrams
from .shared import hinted, maybe_broadcast, scratch, small_batches, stored
from .tokens import vocabulary_size

ORDER = 2
#: Bits of the filter that keeps most texts out of the join with the ids of trusted rows: 1,024 bitmaps of 4 KB at most, whatever the input.
FILTER_BITS = 25
#: The quantile of a language's trusted rows that is its limit.
QUANTILE = 0.99
#: Bins of perplexity in which a quantile is looked up first: 1,000 to a unit of its logarithm.
BINS = 1000


def perplexities(docs: DataFrame, train: DataFrame, tokenizer: str, order: int, *columns: str) -> DataFrame:
    """``columns``, n_tokens and perplexity (e to the mean loss of a token) of each row's whole text under the model of ``train`` (text); null without tokens."""
    counts = stored(ngrams.counts_of(train, tokenizer, order, "n_seen"), "counts")
    model = ngrams.KneserNey(counts, ["n_seen"], order, vocabulary_size(tokenizer))
    rows = ngrams.placed(docs.select(*columns, "text"), tokenizer, *columns)
    asked = ngrams.asked(rows, tokenizer, order).repartition("gram")  # a row for each block of 32 MB at most, however frequent a gram is
    # The filter drops nothing: it reads the block, so that both branches read the very same exchange.
    distinct = asked.groupBy("gram").agg(F.min("block").alias("least")).filter("least >= 0").select("gram")
    answers = asked.join(model.losses(distinct), "gram")
    out = ngrams.scored(rows, answers, tokenizer, order, columns, ["n_seen"])
    return out.select(*columns, "n_tokens", F.exp(F.try_divide(F.col("n_seen"), F.col("n_tokens"))).alias("perplexity"))


def trusted_ids(labels: DataFrame, rows: int | None = None) -> DataFrame:
    """doc_id and train of trusted documents: labelled as good and not as toxic.  Four in five train, by a hash; with ``rows``, only those of the ``rows`` least hashes."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).filter("q = 1 and t = 0").select("doc_id", F.xxhash64("doc_id").alias("h"))
    train = F.pmod("h", F.lit(5)) != 0
    if rows is None:
        return stored(good.select("doc_id", train.alias("train")), "trusted-ids")
    good = stored(good, "trusted")
    sample = hinted(stored(good.orderBy("h", "doc_id").limit(rows).select("doc_id", F.lit(True).alias("sampled")), "sample"))
    return stored(good.join(sample, "doc_id", "left").select("doc_id", (F.coalesce("sampled", F.lit(False)) & train).alias("train")), "trusted-ids")


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids`` (doc_id).

    A Bloom filter of one hash and a fixed size drops most others as they are read, so a shuffled join, which is exact, moves few texts in vain.
    """
    ids = ids.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    marks = ids.groupBy(F.shiftright(bit, 15).alias("_bucket")).agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit((1 << 15) - 1))).alias("_marks"))
    place = F.col("_bit").bitwiseAND(F.lit((1 << 15) - 1)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_marks"), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    near = docs.filter("doc_id is not null").withColumn("_bit", bit).join(F.broadcast(marks), F.shiftright("_bit", 15) == F.col("_bucket"))  # 4 MB at most
    near = near.filter(F.bit_get(byte, place.bitwiseAND(F.lit(7))) == 1)
    return near.select(*docs.columns).join(ids.hint("merge"), "doc_id", "left_semi")


def quantiles(values: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """key, own, n: the exact quantile (interpolated) of ``values`` (key, perplexity) and their number, by key.

    Numbers of rows by bin say in which bins a key's ranks lie; only these bins' rows are sorted.
    """
    binned = values.withColumn("bin", F.floor(F.ln("perplexity") * BINS))
    so_far = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = binned.groupBy("key", "bin").agg(F.count(F.lit(1)).alias("m")).withColumn("upto", F.sum("m").over(so_far)).withColumn("n", F.sum("m").over(Window.partitionBy("key")))
    place = F.lit(quantile) * (F.col("n") - 1)
    sizes = sizes.withColumn("low", F.floor(place)).withColumn("high", F.ceil(place)).withColumn("part", place - F.floor(place))
    bins = sizes.filter("upto > low and upto - m <= high").select("key", "bin", (F.col("upto") - F.col("m")).alias("under"), "n", "low", "high", "part")
    ranked = binned.join(F.broadcast(bins), ["key", "bin"])  # two bins for each key at most
    ranked = ranked.withColumn("rank", F.col("under") + F.row_number().over(Window.partitionBy("key", "bin").orderBy("perplexity")) - 1)
    at = lambda c: F.max(F.when(F.col("rank") == F.col(c), F.col("perplexity")))
    ends = ranked.groupBy("key", "n", "part").agg(at("low").alias("a"), at("high").alias("b"))
    return ends.select("key", (F.col("a") + F.col("part") * (F.col("b") - F.col("a"))).alias("own"), "n")


def score_documents(docs: DataFrame, labels: DataFrame, tokenizer: str, order: int = ORDER, quantile: float = QUANTILE, rows: int | None = None) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity, limit, accepted of each row of ``docs`` (doc_id, text, lang).

    labels: doc_id, quality, toxic; a document with several labels is trusted if all are good.  A row is rejected if its
    perplexity is over the limit of its language, or it has no tokens.  The model is fitted on four in five of all trusted rows (of
    ``rows`` of them, if that is given); limits are those of all others.  Languages without any of them, and null ones, get the common limit; without any trusted rows there is no limit
    and all rows with tokens are accepted.  Repeated rows are judged each; labels with a null doc_id aren't used; an empty table gives no
    rows; other columns aren't read.
    """
    with scratch():
        trusted = trusted_ids(labels.select("doc_id", "quality", "toxic").filter("doc_id is not null"), rows)
        train = with_ids(docs.select("doc_id", "text"), trusted.filter("train").select("doc_id"))
        with small_batches(docs.sparkSession):
            scored = stored(perplexities(docs, train, tokenizer, order, "doc_id", "lang"), "scored", kept=True)
        others = trusted.filter(~F.col("train")).select("doc_id")
        held = scored.filter("perplexity is not null").join(maybe_broadcast(others, 16 * others.count()), "doc_id")
        held = stored(held.select("lang", "perplexity"), "held", kept=True)
    common = quantiles(held.select(F.lit(0).alias("key"), "perplexity"), quantile).agg(F.max("own").alias("common"))
    by_lang = quantiles(held.filter("lang is not null").withColumnRenamed("lang", "key"), quantile)
    out = scored.join(F.broadcast(by_lang.select(F.col("key").alias("lang"), "own")), "lang", "left").crossJoin(F.broadcast(common))  # a row for each language; one row
    limit = F.coalesce("own", "common")
    accepted = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= limit, F.lit(True))
    return out.select("doc_id", "lang", "n_tokens", "perplexity", limit.alias("limit"), accepted.alias("accepted"))


def keep_accepted(docs: DataFrame, labels: DataFrame, tokenizer: str) -> DataFrame:
    """``docs`` without the documents that :func:`score_documents` rejects; all columns stay, rows of a key stay if one of them is accepted."""
    with scratch():
        kept = stored(score_documents(docs, labels, tokenizer).filter("accepted").select(F.col("doc_id").alias("_kept")).distinct(), "accepted", kept=True)
    return docs.join(hinted(kept), docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")
