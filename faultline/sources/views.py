"""The driver's tables as the entities of the library, with the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators.line_table import numbered_lines

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
TEMPERATURES = [0.0, 0.1, 0.3, 0.5, 0.7, 1.0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, sf_dir: str, repository: str = "source") -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("log_id"), F.col("doc_id").alias("ord"), F.col(repository).alias("repository"), F.col("lang").alias("workflow_name"), F.coalesce("text", F.lit("")).alias("log_content"))


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log for each user: a line for each event, by time.  A user's events are one log's lines."""
    e = table(spark, sf_dir, "events")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), "event_type", F.lit(": k-"), F.regexp_extract("props", r"(\d+)", 1))
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", line.alias("line")))).alias("x"))
    return rows.select(F.col("user_id").cast("string").alias("log_id"), F.col("user_id").alias("ord"), (F.col("user_id") % 17).cast("string").alias("repository"), F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("log_content"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the event logs as rows: log_id, line_no, line.  Places are counted by day, then over days."""
    e = table(spark, sf_dir, "events")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), "event_type", F.lit(": k-"), F.regexp_extract("props", r"(\d+)", 1))
    rows = e.select(F.col("user_id").cast("string").alias("log_id"), "ts", "event_id", line.alias("line"))
    return numbered_lines(rows, "log_id", ["ts", "event_id"], F.to_date("ts")).select("log_id", "line_no", "line")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' predictions for each order; which are right follows from its keys."""
    o = table(spark, sf_dir, "orders")
    following = F.element_at(F.array(*[F.lit(p) for p in PRIORITIES[1:] + PRIORITIES[:1]]), F.substring("o_orderpriority", 1, 1).cast("int"))
    both = o.withColumn("model", F.explode(F.array(F.lit("gpt-4o-mini"), F.lit("gpt-4o"))))
    right = F.when(F.col("model") == "gpt-4o-mini", F.col("o_orderkey") % 10 < 7).otherwise(F.col("o_custkey") % 10 < 6)
    return both.select(
        F.col("o_orderkey").cast("string").alias("log_id"), F.col("o_orderkey").alias("ord"), "model", F.lit("openai").alias("provider"), F.when(right, F.col("o_orderpriority")).otherwise(following).alias("predicted_error_type"),
        F.col("o_orderpriority").alias("actual_error_type"), ((F.col("o_orderkey") % 100) / 100).alias("confidence"), F.col("o_totalprice").alias("execution_time_ms"), (F.col("o_orderstatus") == "F").alias("hallucination_detected"),
        (F.col("o_orderkey") % 4000).alias("prompt_tokens"), (F.col("o_orderkey") % 400).alias("completion_tokens"), (F.col("o_orderkey") % 4000 + F.col("o_orderkey") % 400).alias("total_tokens"),
        F.array((F.col("o_orderkey") % 7).cast("int"), (F.col("o_orderkey") % 5).cast("int"), (F.col("o_orderkey") % 7).cast("int")).alias("predicted_lines"), F.when(F.col("o_orderkey") % 6 == 0, F.array().cast("array<int>")).otherwise(F.array((F.col("o_orderkey") % 3).cast("int"), (F.col("o_orderkey") % 7).cast("int"))).alias("actual_lines"),
        F.element_at(F.array(F.lit("500"), F.lit("1000"), F.lit("2000")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("strategy"),
    )


def temperatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictions, with the temperature they were made at."""
    values = F.array(*[F.lit(t) for t in TEMPERATURES])
    return predictions(spark, sf_dir).withColumn("temperature", F.element_at(values, (F.col("ord") % len(TEMPERATURES) + 1).cast("int")))


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").filter(k % 10 != 9)
    return o.select(k.cast("string").alias("log_id"), k.alias("ord"), F.col("o_orderpriority").alias("actual_error_type"), (k % 4 != 0).alias("type_correct"), (k % 3 != 0).alias("root_cause_correct"), (k % 5 != 0).alias("fix_actionable"), (k % 7 != 0).alias("evidence_accurate"), (1 + k % 5).cast("int").alias("quality_rating"), ((k % 100) / 100).alias("llm_confidence"), (F.col("o_orderstatus") == "F").alias("hallucination_detected"), F.col("o_totalprice").alias("execution_time_ms"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("o_custkey").alias("participant_id"), k.alias("task_id"), F.col("c_mktsegment").alias("ci_cd_experience"), (k % 2 == 0).alias("with_assistance"), F.col("o_totalprice").alias("time_to_insight"), (1 + k % 5).cast("int").alias("confidence_rating"), (1 + k % 4).cast("int").alias("difficulty_rating"), F.when(k % 11 != 0, (1 + k % 3).cast("int")).alias("helpfulness_rating"), F.col("o_orderpriority").alias("identified_error_type"), F.when(k % 3 == 0, "rotated").otherwise(F.col("o_orderpriority")).alias("actual_error_type"))


_NEXT = "CASE o_orderpriority WHEN '1-URGENT' THEN '2-HIGH' WHEN '2-HIGH' THEN '3-MEDIUM' WHEN '3-MEDIUM' THEN '4-NOT SPECIFIED' WHEN '4-NOT SPECIFIED' THEN '5-LOW' ELSE '1-URGENT' END"
#: The same views in SQL, for ``WITH``.
SQL = {
    "logs": "logs AS (SELECT CAST(doc_id AS VARCHAR) AS log_id, doc_id AS ord, source AS repository, lang AS workflow_name, coalesce(text, '') AS log_content FROM documents)",
    "event_logs": r"event_logs AS (SELECT CAST(user_id AS VARCHAR) AS log_id, user_id AS ord, CAST(user_id % 17 AS VARCHAR) AS repository, string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_type || ': k-' || regexp_extract(props, '(\d+)', 1), chr(10) ORDER BY ts, event_id) AS log_content FROM events GROUP BY user_id)",
    "predictions": f"predictions AS (SELECT CAST(o_orderkey AS VARCHAR) AS log_id, o_orderkey AS ord, model, CASE WHEN (model = 'gpt-4o-mini' AND o_orderkey % 10 < 7) OR (model = 'gpt-4o' AND o_custkey % 10 < 6) THEN o_orderpriority ELSE {_NEXT} END AS predicted_error_type, o_orderpriority AS actual_error_type, (o_orderkey % 100) / 100 AS confidence, o_totalprice AS execution_time_ms, o_orderstatus = 'F' AS hallucination_detected, o_orderkey % 4000 AS prompt_tokens, o_orderkey % 400 AS completion_tokens, o_orderkey % 4000 + o_orderkey % 400 AS total_tokens, [o_orderkey % 7, o_orderkey % 5] AS pl, CASE WHEN o_orderkey % 6 = 0 THEN [] ELSE [o_orderkey % 3, o_orderkey % 7] END AS al, ['500', '1000', '2000'][o_orderkey % 3 + 1] AS strategy, CASE model WHEN 'gpt-4o-mini' THEN (o_orderkey % 4000) * 0.15e-6 + (o_orderkey % 400) * 0.6e-6 ELSE (o_orderkey % 4000) * 2.5e-6 + (o_orderkey % 400) * 10e-6 END AS cost_usd FROM orders, (VALUES ('gpt-4o-mini'), ('gpt-4o')) m(model))",
    "temperatures": f"temperatures AS (SELECT *, CAST({TEMPERATURES}[ord % {len(TEMPERATURES)} + 1] AS DOUBLE) AS temperature FROM predictions)",
    "ground_truth": "ground_truth AS (SELECT CAST(o_orderkey AS VARCHAR) AS log_id, o_orderpriority AS actual_error_type, o_orderkey % 4 <> 0 AS type_correct, o_orderkey % 3 <> 0 AS root_cause_correct, o_orderkey % 5 <> 0 AS fix_actionable, o_orderkey % 7 <> 0 AS evidence_accurate, CAST(1 + o_orderkey % 5 AS INTEGER) AS quality_rating, (o_orderkey % 100) / 100 AS llm_confidence, o_orderstatus = 'F' AS hallucination_detected, o_totalprice AS execution_time_ms FROM orders WHERE o_orderkey % 10 <> 9)",
    "responses": "responses AS (SELECT o_custkey AS participant_id, c_mktsegment AS ci_cd_experience, o_orderkey % 2 = 0 AS w, o_totalprice AS t, 1 + o_orderkey % 5 AS confidence_rating, 1 + o_orderkey % 4 AS difficulty_rating, CASE WHEN o_orderkey % 11 <> 0 THEN 1 + o_orderkey % 3 END AS helpfulness_rating, CAST(o_orderkey % 3 <> 0 AS INTEGER) AS r FROM orders JOIN customer ON o_custkey = c_custkey)",
}
