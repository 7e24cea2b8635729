"""Language-model scoring by cross-entropy difference (operator 4).

A target and a background model are counted over all documents, with the same order, smoothing and vocabulary (a tokenizer's).  A document's
score is the mean over its tokens of the target's loss less the background's: the lower, the more it is like the target.  No document
is scored by a target model that has counted it: target documents have two folds, by a hash of their text, with a model each, and every
document is scored by the model of the fold that its own hash isn't in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .shared import hinted, maybe_broadcast, scratch, small_batches, stored
from .tokens import vocabulary_size

ORDER = 2
MODELS = ("t0", "t1", "all")


def fold_of(text: Column) -> Column:
    """0 or 1; equal texts are in one fold."""
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit("")), F.lit("fold")), F.lit(2)).cast("int")


def cross_entropy_difference(docs: DataFrame, tokenizer: str, target: str = "is_target", order: int = ORDER) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score of each row of ``docs`` (doc_id, text and a boolean column).

    Target models are fitted on the rows where ``target`` is true (null: false), the background on all rows.  Losses are nats a token;
    a null text or one without tokens has 0 tokens and null losses.  A target model without rows is uniform.  Repeated rows
    count and are scored each; an empty table gives no rows; other columns aren't read.
    """
    of = lambda k: F.coalesce(F.col(target), F.lit(False)) & (F.col("fold") == k)
    marked = docs.select("doc_id", "text", target, fold_of(F.col("text")).alias("fold")).select("doc_id", "fold", of(0).alias("t0"), of(1).alias("t1"), F.lit(True).alias("all"), "text")
    columns, names = ("doc_id", "fold", *MODELS), [f"n_{m}" for m in MODELS]
    rows = ngrams.placed(marked, tokenizer, *columns)
    with small_batches(docs.sparkSession):
        asked = stored(ngrams.asked(rows, tokenizer, order, MODELS), "asked")
    with scratch():
        counts = stored(ngrams.counted(asked, MODELS), "counts")
        model = ngrams.KneserNey(counts, names, order, vocabulary_size(tokenizer))
        losses = stored(model.losses(counts.select("gram")), "losses", kept=True)
    answers = asked.select("block", "gram").join(maybe_broadcast(losses, 64 * losses.count()), "gram")
    sums = ngrams.scored(rows, answers, tokenizer, order, columns, names)
    t = F.try_divide(F.when(F.col("fold") == 0, F.col("n_t1")).otherwise(F.col("n_t0")), F.col("n_tokens"))
    b = F.try_divide(F.col("n_all"), F.col("n_tokens"))
    return sums.select("doc_id", "n_tokens", t.alias("target_loss"), b.alias("background_loss"), (t - b).alias("score"))


def with_target(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and is_target: labelled as good by all its labels and as toxic by none."""
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).filter("q = 1 and t = 0").select("doc_id", F.lit(True).alias("is_target"))
    good = stored(good, "target")
    return docs.select("doc_id", "text").join(hinted(good), "doc_id", "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))
