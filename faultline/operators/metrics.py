"""Evaluation of diagnoses against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .baselines import heuristic_counts, heuristic_lines, heuristic_type, regex_lines, regex_type


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def line_overlap(predictions: DataFrame) -> DataFrame:
    """Adds line_precision, line_recall, line_f1 of distinct lines; all 0 without actual lines."""
    hit = F.size(F.array_intersect("predicted_lines", "actual_lines"))
    p = _zero(F.try_divide(hit, F.size(F.array_distinct("predicted_lines"))))
    r = _zero(F.try_divide(hit, F.size(F.array_distinct("actual_lines"))))
    out = predictions.withColumn("line_precision", p).withColumn("line_recall", r)
    return out.withColumn("line_f1", _zero(F.try_divide(2 * F.col("line_precision") * F.col("line_recall"), F.col("line_precision") + F.col("line_recall"))))


def metrics(predictions: DataFrame, *by: str) -> DataFrame:
    """n, accuracy, means of the logs' precision, recall and F1, hallucination rate, mean confidence and time, cost; by ``by``."""
    right = (F.col("predicted_error_type") == F.col("actual_error_type")).cast("double")
    return line_overlap(predictions).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        _zero(F.avg(right)).alias("accuracy"),
        _zero(F.avg("line_precision")).alias("precision"),
        _zero(F.avg("line_recall")).alias("recall"),
        _zero(F.avg("line_f1")).alias("f1"),
        _zero(F.avg(F.col("hallucination_detected").cast("double"))).alias("hallucination_rate"),
        _zero(F.avg("confidence")).alias("mean_confidence"),
        _zero(F.avg("execution_time_ms")).alias("mean_execution_time_ms"),
        _zero(F.sum("cost_usd")).alias("total_cost_usd"),
        _zero(F.sum("cost_usd") / F.count(F.lit(1))).alias("cost_per_diagnosis_usd"),
    )


def confusion(predictions: DataFrame) -> DataFrame:
    """actual, predicted, n for all pairs of labels that occur (a handful), zeros filled."""
    labels = predictions.select(F.col("actual_error_type").alias("label")).union(predictions.select("predicted_error_type")).distinct()
    n = predictions.groupBy(F.col("actual_error_type").alias("actual"), F.col("predicted_error_type").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    grid = labels.select(F.col("label").alias("actual")).crossJoin(labels.select(F.col("label").alias("predicted")))
    return grid.join(n, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def hallucination_by_type(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("actual_error_type").agg(F.avg(F.col("hallucination_detected").cast("double")).alias("hallucination_rate"))


def confidence_histogram(predictions: DataFrame, bins: int = 20) -> DataFrame:
    """hallucination_detected, bin (from 1), n over equal bins from the least to the greatest confidence; the last is closed."""
    span = predictions.agg(F.min("confidence").alias("lo"), F.max("confidence").alias("hi"))
    span = span.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    at = F.least(F.floor((F.col("confidence") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1, F.lit(bins))
    return predictions.crossJoin(F.broadcast(span)).groupBy("hallucination_detected", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row of bounds


def human_judged(truth: DataFrame) -> DataFrame:
    """n, five counts and rates, mean quality, confidence and time of annotated diagnoses."""
    flags = {"type_accuracy": "type_correct", "root_cause_accuracy": "root_cause_correct", "fix_rate": "fix_actionable", "evidence_rate": "evidence_accurate", "hallucination_rate": "hallucination_detected"}
    return truth.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f"{c}_n") for c in flags.values()], *[_zero(F.avg(F.col(c).cast("double"))).alias(k) for k, c in flags.items()], _zero(F.avg("quality_rating")).alias("mean_quality"), _zero(F.avg("llm_confidence")).alias("mean_confidence"), _zero(F.avg("execution_time_ms")).alias("mean_time_ms"))


def rating_distribution(truth: DataFrame) -> DataFrame:
    levels = truth.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("rating"))
    n = truth.groupBy(F.col("quality_rating").cast("int").alias("rating")).agg(F.count(F.lit(1)).alias("n"))
    return levels.join(n, "rating", "left").select("rating", F.coalesce("n", F.lit(0)).alias("n"))


def by_type(truth: DataFrame) -> DataFrame:
    return truth.groupBy("actual_error_type").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("type_correct").cast("double")).alias("type_accuracy"), F.avg(F.col("root_cause_correct").cast("double")).alias("root_cause_accuracy"), F.avg("quality_rating").alias("mean_quality"))


def baseline_accuracy(truth: DataFrame, contents: DataFrame, kinds: dict[str, list[str]] | None = None) -> DataFrame:
    """n, missing, regex_accuracy, heuristic_accuracy: ground truth without content is left out and counted."""
    joined = truth.select("log_id", "actual_error_type").join(contents.select("log_id", "log_content"), "log_id", "left")
    c = F.col("log_content")
    judged = joined.select(c.isNull().alias("gone"), (regex_type(c) == F.col("actual_error_type")).cast("double").alias("r"), (heuristic_type(heuristic_counts(c)) == F.col("actual_error_type")).cast("double").alias("h"))
    return judged.agg(F.count_if(~F.col("gone")).alias("n"), F.count_if("gone").alias("missing"), _zero(F.avg(F.when(~F.col("gone"), F.col("r")))).alias("regex_accuracy"), _zero(F.avg(F.when(~F.col("gone"), F.col("h")))).alias("heuristic_accuracy"))


def last_truth(truth: DataFrame) -> DataFrame:
    """One row for each log_id, the last by ord."""
    return truth.groupBy("log_id").agg(F.max_by(F.struct(*[c for c in truth.columns if c != "log_id"]), "ord").alias("t")).select("log_id", "t.*")


def model_metrics(results: DataFrame, truth: DataFrame) -> DataFrame:
    """By model: n, mean confidence and time, tokens, cost, cost a diagnosis, matched rows and accuracy on these (null without any)."""
    joined = results.join(last_truth(truth).select("log_id", F.col("actual_error_type").alias("truth")), "log_id", "left")
    return joined.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), _zero(F.avg("confidence")).alias("mean_confidence"), _zero(F.avg("execution_time_ms")).alias("mean_time_ms"), F.sum("total_tokens").alias("total_tokens"),
        _zero(F.sum("cost_usd")).alias("total_cost_usd"), _zero(F.sum("cost_usd") / F.count(F.lit(1))).alias("cost_per_diagnosis_usd"), F.count("truth").alias("matched"),
        F.avg(F.when(F.col("truth").isNotNull(), (F.col("predicted_error_type") == F.col("truth")).cast("double"))).alias("accuracy"),
    )


def type_distribution(results: DataFrame) -> DataFrame:
    return results.groupBy("model", F.col("predicted_error_type").alias("error_type")).agg(F.count(F.lit(1)).alias("n"))


def cost_accuracy(models: DataFrame) -> DataFrame:
    """Models with an accuracy, and the size of their bubble."""
    size = F.greatest(F.lit(60.0), 300 - F.col("mean_time_ms") / 10)
    return models.filter("accuracy is not null").select("model", "accuracy", "cost_per_diagnosis_usd", "mean_time_ms", size.alias("bubble"))


def aligned(results: DataFrame, truth: DataFrame) -> DataFrame:
    """model_a, model_b, n10, n01, n, right_a, right_b over the logs that both models of a pair and the truth have.

    Correctness is gathered by log first (a value for each model), so pairs are formed within a row.
    """
    last = results.groupBy("log_id", "model").agg(F.max_by("predicted_error_type", "ord").alias("p"))
    right = last.join(last_truth(truth).select("log_id", "actual_error_type"), "log_id").select("log_id", F.struct("model", (F.col("p") == F.col("actual_error_type")).alias("ok")).alias("m"))
    per_log = right.groupBy("log_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    pairs = F.flatten(F.transform("ms", lambda a: F.transform(F.filter("ms", lambda b: b["model"] > a["model"]), lambda b: F.struct(a["model"].alias("model_a"), b["model"].alias("model_b"), a["ok"].alias("a"), b["ok"].alias("b")))))
    return per_log.select(F.explode(pairs).alias("p")).select("p.*").groupBy("model_a", "model_b").agg(F.count_if(F.col("a") & ~F.col("b")).alias("n10"), F.count_if(~F.col("a") & F.col("b")).alias("n01"), F.count(F.lit(1)).alias("n"), F.count_if("a").alias("right_a"), F.count_if("b").alias("right_b"))


def baseline_predictions(cases: DataFrame) -> DataFrame:
    """Predictions of both rule baselines for cases (log_id, log_content, actual_error_type, actual_lines); a case is read once."""
    c = F.col("log_content")
    of = lambda name, kind, found, ms: F.struct(F.lit(name).alias("approach"), kind.alias("predicted_error_type"), found.alias("predicted_lines"), F.lit(ms).alias("execution_time_ms"))
    typed = cases.withColumn("kind", heuristic_type(heuristic_counts(c)))
    both = F.array(of("regex", regex_type(c), regex_lines(c), 5.0), of("heuristic", F.col("kind"), heuristic_lines(c, F.col("kind")), 8.0))
    common = (F.lit(1.0).alias("confidence"), F.lit(False).alias("hallucination_detected"), F.lit(0.0).alias("cost_usd"))
    return typed.select("log_id", "actual_error_type", "actual_lines", F.explode(both).alias("p")).select("log_id", "p.*", "actual_error_type", "actual_lines", *common)
