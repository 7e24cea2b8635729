"""Analysis of a user study with and without assistance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import t_tail

WITH, WITHOUT = "with_assistance", "not with_assistance"


def joined(responses: DataFrame, participants: DataFrame, tasks: DataFrame) -> DataFrame:
    return responses.join(participants.select("participant_id", "years_experience", "ci_cd_experience"), "participant_id").join(tasks.select("task_id", "actual_error_type"), "task_id")


def _arm(value, cond):
    return F.avg(F.when(F.expr(cond), value))


def time_to_insight(responses: DataFrame) -> DataFrame:
    """Means, medians, reduction in percent, pooled t (without less with) and its two-sided p."""
    t = F.col("time_to_insight")
    out = responses.agg(*[f(F.when(F.expr(c), t)).alias(f"{n}_{arm}") for arm, c in (("with", WITH), ("without", WITHOUT)) for n, f in (("mean", F.avg), ("median", F.median), ("var", F.var_samp), ("n", F.count))])
    df = F.col("n_with") + F.col("n_without") - 2
    pooled = F.try_divide((F.col("n_with") - 1) * F.col("var_with") + (F.col("n_without") - 1) * F.col("var_without"), df)
    se = F.sqrt(pooled * (F.try_divide(F.lit(1.0), F.col("n_with")) + F.try_divide(F.lit(1.0), F.col("n_without"))))
    stat = F.try_divide(F.col("mean_without") - F.col("mean_with"), se)
    reduction = (1 - F.try_divide(F.col("mean_with"), F.col("mean_without"))) * 100
    out = out.select("mean_with", "mean_without", "median_with", "median_without", reduction.alias("reduction_percent"), stat.alias("t"), df.cast("double").alias("df"))
    return out.withColumn("p_value", t_tail("t", "df"))


def accuracy(responses: DataFrame) -> DataFrame:
    right = (F.col("identified_error_type") == F.col("actual_error_type")).cast("double")
    out = responses.agg(_arm(right, WITH).alias("with_assistance"), _arm(right, WITHOUT).alias("without_assistance"))
    return out.withColumn("improvement_points", (F.col("with_assistance") - F.col("without_assistance")) * 100)


def confidence(responses: DataFrame) -> DataFrame:
    out = responses.agg(_arm(F.col("confidence_rating"), WITH).alias("with_assistance"), _arm(F.col("confidence_rating"), WITHOUT).alias("without_assistance"))
    return out.withColumn("difference", F.col("with_assistance") - F.col("without_assistance"))


def by_experience(responses: DataFrame) -> DataFrame:
    right = (F.col("identified_error_type") == F.col("actual_error_type")).cast("double")
    t = F.col("time_to_insight")
    reduction = F.coalesce((1 - F.try_divide(_arm(t, WITH), _arm(t, WITHOUT))) * 100, F.lit(0.0))
    return responses.groupBy("ci_cd_experience").agg(F.count(F.lit(1)).alias("n"), reduction.alias("reduction_percent"), F.coalesce(_arm(right, WITH), F.lit(0.0)).alias("accuracy_with"))


def totals(responses: DataFrame) -> DataFrame:
    return responses.agg(F.count(F.lit(1)).alias("responses"), F.countDistinct("participant_id").alias("participants"), F.avg("time_to_insight").alias("mean_time"), F.count_if(F.expr(WITH)).alias("n_with"), F.count_if(F.expr(WITHOUT)).alias("n_without"))


def quartiles(responses: DataFrame) -> DataFrame:
    q = F.percentile("time_to_insight", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return responses.groupBy("with_assistance").agg(q.alias("q"), F.avg("difficulty_rating").alias("mean_difficulty")).select("with_assistance", *(F.get("q", i).alias(f"q{i + 1}") for i in range(3)), "mean_difficulty")


def helpfulness(responses: DataFrame) -> DataFrame:
    """rating, n of assisted responses; 1 to 5, zeros filled."""
    levels = responses.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("rating"))
    n = responses.filter("with_assistance and helpfulness_rating is not null").groupBy(F.col("helpfulness_rating").cast("int").alias("rating")).agg(F.count(F.lit(1)).alias("n"))
    return levels.join(n, "rating", "left").select("rating", F.coalesce("n", F.lit(0)).alias("n"))


def assignments(logs: DataFrame, tasks: int = 8, by: str | None = None) -> DataFrame:
    """task_id, log_id, position, with_assistance of the first ``tasks`` logs (of each ``by``); every second is assisted, from the first."""
    first = logs if by else logs.orderBy("ord", "log_id").limit(tasks)
    rn = F.row_number().over(Window.partitionBy(*([by] if by else [F.lit(0)])).orderBy("ord", "log_id")) - 1
    own = first.withColumn("position", rn).filter(F.col("position") < tasks)
    return own.select(*([by] if by else []), F.concat(F.lit("task_"), "log_id", F.lit("_"), F.col("position").cast("string")).alias("task_id"), "log_id", "position", (F.col("position") % 2 == 0).alias("with_assistance"))
