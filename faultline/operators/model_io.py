"""Prompts out, replies in, costs, and what is still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.text import content, once

# US dollars a token, in and out
PRICES = {
    "gpt-4o-mini": (0.15e-6, 0.60e-6),
    "gpt-4o": (2.50e-6, 10.0e-6),
    "gpt-3.5-turbo": (0.50e-6, 1.50e-6),
    "claude-3-haiku-20240307": (0.25e-6, 1.25e-6),
    "claude-3-sonnet-20240229": (3.00e-6, 15.0e-6),
}
ERROR_TYPES = ["dependency_error", "test_failure", "build_configuration", "timeout", "permission_denied", "syntax_error", "network_error", "unknown"]
DIAGNOSIS = "error_type string, failure_lines array<int>, root_cause string, suggested_fix string, confidence_score double, grounded_evidence array<struct<line_number:int,content:string,is_error:boolean>>, reasoning string"
#: The prompt around the context and the log; a template of one's own can be given.
TEMPLATE = "Diagnose the failed build below. Reply with one JSON object: error_type, failure_lines, root_cause, suggested_fix, confidence_score, grounded_evidence, reasoning.\n{context}\nLOG:\n{log}"


def prompt(log: Column, repository: Column, workflow: Column, ci_system: Column, run_url: Column, template: str = TEMPLATE) -> Column:
    named = (("Repository", repository), ("Workflow", workflow), ("CI System", ci_system), ("Run URL", run_url))
    listed = F.concat_ws("\n", *[F.when(content(c) != "", F.concat(F.lit(f"- {n}: "), c)) for n, c in named])
    context = F.when(listed != "", F.concat(F.lit("\nCONTEXT:\n"), listed, F.lit("\n"))).otherwise("")
    before, _, rest = template.partition("{context}")
    between, _, after = rest.partition("{log}")
    return F.concat(F.lit(before), context, F.lit(between), content(log), F.lit(after))


def _json_of(reply: Column) -> Column:
    """The text from a reply's first brace to its last, or all of it; null if that isn't one JSON object and nothing else."""
    inner = lambda r: once(F.regexp_extract(r, r"(?s)\{.*\}", 0), lambda x: F.when(x != "", x).otherwise(r))
    whole = lambda t: F.json_object_keys(t).isNotNull() & (F.json_array_length(F.concat(F.lit("["), t, F.lit("]"))) == 1)
    return once(content(reply), lambda r: once(inner(r), lambda t: F.when(whole(t), t)))


def _evaluated(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns`` that are evaluated once for each row: Spark merges no generator with what uses its columns, and filters stay above it."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def parsed(reply: Column) -> Column:
    """The diagnosis in a reply (from the first brace to the last), or null for bad JSON and unknown error types."""
    return once(F.from_json(_json_of(reply), DIAGNOSIS, {"mode": "PERMISSIVE"}), lambda d: F.when(d["error_type"].isin(ERROR_TYPES), d))


#: What a reply must have; without grounded_evidence it cites nothing.
REQUIRED = ("error_type", "failure_lines", "root_cause", "suggested_fix", "confidence_score", "reasoning")


def judged(replies: DataFrame, reply: str = "reply", grounding: Column | None = None) -> DataFrame:
    """``replies`` with diagnosis and reason: one of them is null.

    The JSON of a reply goes from its first brace to its last.  Reasons, the first that holds: bad_json (it isn't an object), missing_field (a required
    one isn't there, or null; detail names the first), bad_field (one isn't of its kind, as a text for a number), unknown_type (of
    error), out_of_range (the confidence, times ``grounding`` if that is given, isn't from 0 to 1).  No reply is lost; detail has the field, the unknown type or the value.
    """
    raw = ", ".join(f"{f} string" for f in (*REQUIRED, "grounded_evidence"))  # each field as it is written
    read = _evaluated(replies, _json=_json_of(F.col(reply)))
    read = _evaluated(read, _raw=F.from_json("_json", raw), _d=F.from_json("_json", f"{DIAGNOSIS}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    d = F.col("_d")
    missing = F.coalesce(*(F.when(F.col("_raw")[f].isNull(), F.lit(f)) for f in REQUIRED))
    named = lambda c: F.array_compact(F.array(*c))
    wrong = F.get(named([F.when(F.col("_raw")[f].isNotNull() & d[f].isNull(), F.lit(f)) for f in (*REQUIRED, "grounded_evidence")]), F.lit(0))
    holes = F.exists(d["failure_lines"], lambda x: x.isNull())
    cited = F.exists(d["grounded_evidence"], lambda x: x.isNull() | x["line_number"].isNull() | x["content"].isNull())
    wrong = F.coalesce(wrong, F.when(holes, "failure_lines"), F.when(cited, "grounded_evidence"))
    value = d["confidence_score"] * (F.lit(1.0) if grounding is None else F.coalesce(grounding, F.lit(0.0)))
    why = lambda name, detail: F.struct(F.lit(name).alias("reason"), detail.alias("detail"))
    reason = (
        F.when(F.col("_json").isNull(), why("bad_json", F.lit(None).cast("string")))
        .when(missing.isNotNull(), why("missing_field", missing))
        .when(wrong.isNotNull(), why("bad_field", wrong))
        .when(~d["error_type"].isin(ERROR_TYPES), why("unknown_type", d["error_type"]))
        .when(~F.coalesce((value >= 0) & (value <= 1), F.lit(False)) | F.isnan(value), why("out_of_range", F.col("_raw")["confidence_score"]))
    )
    whole = F.struct(*(d[f].alias(f) for f in (*REQUIRED[:5], "grounded_evidence", "reasoning")))
    out = _evaluated(read, _why=reason)
    return out.select(*replies.columns, F.when(F.col("_why").isNull(), whole).alias("diagnosis"), F.col("_why.reason").alias("reason"), F.col("_why.detail").alias("detail"))


def good_and_bad(replies: DataFrame, reply: str = "reply", grounding: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`judged` replies as two tables: those with a diagnosis, and those with a reason and its detail; together all replies."""
    every = judged(replies, reply, grounding)
    return every.filter("reason is null").drop("reason", "detail"), every.filter("reason is not null").drop("diagnosis")


def cost(spend: DataFrame, prices: dict[str, tuple[float, float]] = PRICES) -> DataFrame:
    """``spend`` (model, provider, prompt_tokens, completion_tokens, ...) with cost_usd; unknown models and local providers cost nothing."""
    table = spend.sparkSession.createDataFrame([(m, i, o) for m, (i, o) in prices.items()], "model string, usd_in double, usd_out double")
    paid = F.coalesce(F.col("prompt_tokens") * F.col("usd_in") + F.col("completion_tokens") * F.col("usd_out"), F.lit(0.0))
    joined = spend.join(F.broadcast(table), "model", "left")  # the price list is a constant of this module
    return joined.withColumn("cost_usd", F.when(F.col("provider") == "local", F.lit(0.0)).otherwise(paid)).drop("usd_in", "usd_out")


def pending(logs: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Logs without a row in ``done``; the limit is on the input, before."""
    first = logs if limit is None else logs.orderBy("ord").limit(limit)
    return first.join(done.select("log_id").distinct(), "log_id", "left_anti")


def log_id(c: Column) -> Column:
    return F.substring(F.md5(content(c).cast("binary")), 1, 12)


def summary(diagnosed: DataFrame) -> DataFrame:
    """error_type, n, percent, mean_confidence, mean_time_ms over all diagnoses."""
    by_type = diagnosed.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(1))
    means = diagnosed.agg(F.avg("confidence").alias("mean_confidence"), F.avg("execution_time_ms").alias("mean_time_ms"))
    return by_type.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(every)).crossJoin(F.broadcast(means))  # one row
