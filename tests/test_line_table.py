"""Logs as tables of lines against logs as texts."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import baselines, line_table, reduction, triage
from faultline.plans.queries import ORACLES, QUERIES
from faultline.sources import views

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def logs(spark):
    rng = np.random.default_rng(2)
    words = ["ok", "all fine", "an error here", "", "some longer line of text", "Fatal", "x" * 60]
    rows = [(f"log{i}", "\n".join(rng.choice(words, n, p=[0.4, 0.2, p, 0.1, 0.2, 0.02, 0.08 - p]))) for i, (n, p) in enumerate([(1, 0.0), (6, 0.05), (7, 0.05), (8, 0.0), (40, 0.02), (150, 0.01), (400, 0.005), (9, 0.0)])]
    rows += [("none", "\n".join(f"line {i}" for i in range(90))), ("empty", ""), ("ends", "error\n" + "a\n" * 30 + "error"), (None, "x\nerror\ny")]
    return spark.createDataFrame(rows, "log_id string, log_content string")


def as_rows(df):
    return sorted((str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect()))


def lines_of(logs):
    return reduction.log_lines(logs).repartition(6, F.col("line"))  # a log's lines anywhere


@pytest.mark.parametrize("segment", [1, 7, 1024])
def test_equal_to_whole_logs(logs, segment):
    logs = logs.filter("log_id is not null")
    lines = lines_of(logs)
    for width in (0, 3, 10):
        assert as_rows(line_table.context_windows(lines, width, segment=segment)) == as_rows(reduction.context_windows(logs, width))
    for most, width in ((5, 2), (30, 9), (1000, 0)):
        assert as_rows(line_table.reduced_lines(lines, most, width, segment=segment)) == as_rows(reduction.reduced_lines(logs, most, width))


@pytest.mark.parametrize("segment", [3, 7, 1024])
def test_cut_equal_to_whole_logs(logs, segment):
    logs = logs.filter("log_id is not null")
    rendered = reduction.log_lines(logs).select("log_id", (F.col("line_no") + 1).alias("rank"), F.col("line").alias("text"))
    for budget in (4, 40, 400, 12000):
        assert as_rows(line_table.truncated(rendered.repartition(5, "text"), budget, segment)) == as_rows(reduction.truncated(rendered, max_tokens=budget))
    assert as_rows(line_table.smart_filter(lines_of(logs), 40, 4, 90, segment=segment)) == as_rows(reduction.smart_filter(logs, 40, 4, 90))


def test_no_lines(spark, logs):
    none = lines_of(logs).limit(0)
    for got in (line_table.context_windows(none), line_table.reduced_lines(none), line_table.smart_filter(none)):
        assert got.count() == 0


def test_halo_has_no_more_than_its_width(spark):
    lines = spark.createDataFrame([("a", i, f"line {i}") for i in range(100)], "log_id string, line_no long, line string")
    held = line_table.with_halo(lines, 3, 10).groupBy("seg").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("own"), F.min("line_no").alias("low"), F.max("line_no").alias("high")).orderBy("seg").collect()
    assert [(r.low, r.high) for r in held if r.own] == [(max(0, 10 * i - 3), min(99, 10 * i + 12)) for i in range(10)]
    assert all(r.n <= 16 and r.own in (0, 10) for r in held)


def test_numbering_by_spans(spark):
    d = views.event_lines(spark, D)
    texts = views.event_logs(spark, D)
    assert as_rows(d) == as_rows(reduction.log_lines(texts).select("log_id", "line_no", "line"))


@pytest.mark.parametrize("name", ["l2_windows_of_lines", "l3_l4_filter_of_lines", "l6_truncated_lines", "t7_triage_of_lines", "b1_b2_baselines_of_lines", "g2_exact_of_lines"])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{D}/events.parquet'")
    got = c.execute(ORACLES[name])
    names = [x[0] for x in got.description]
    want = sorted(str(tuple(v for _, v in sorted(zip(names, r, strict=True)))) for r in got.fetchall())
    assert as_rows(QUERIES[name](spark, D)) == want and want


def noisy(spark):
    rng = np.random.default_rng(5)
    words = ["ok", "2024-10-01T10:00:00Z error at 0xDEAD42 of the module", "npm ERR! failed to build with gradle", "FATAL: timeout while connecting to the server", "Traceback (most recent call last)", "x" * 30, "pytest failed with an exception here", "", "permission denied: docker", "stack trace of the test failure"]
    rows = [(f"l{i:02d}", i, f"r{i % 2}", "\n".join(rng.choice(words, int(rng.integers(1, 60)), p=[0.4, *[0.06] * 8, 0.12]))) for i in range(30)]
    same = "\n".join(["error: the very same thing"] * 30 + ["tail"])
    rows += [(f"s{i}", 50 + i, "r0", same) for i in range(4)] + [("c", 90, "r0", "a\n" * 30 + "The operation was CANCELED"), ("t", 91, "r1", "a\n" * 30 + "401 is unauthorized"), ("two", 92, "r1", "401\nunauthorized\n" * 20), ("empty", 93, "r1", "")]
    return spark.createDataFrame(rows, "log_id string, ord long, repository string, log_content string")


@pytest.mark.parametrize("segment", [1, 7, 1024])
def test_triage_and_baselines_equal_to_whole_logs(spark, segment):
    logs = noisy(spark)
    lines = lines_of(logs)
    assert as_rows(line_table.triaged(logs, lines, segment=segment)) == as_rows(triage.triage(logs))
    assert {r.reason for r in line_table.triaged(logs, lines, segment=segment).collect()} == {None, *triage.REASONS}
    c = F.col("log_content")
    kind = logs.withColumn("heuristic_type", baselines.heuristic_type(baselines.heuristic_counts(c)))
    want = kind.select("log_id", baselines.regex_type(c).alias("regex_type"), baselines.regex_lines(c).alias("regex_lines"), "heuristic_type", baselines.heuristic_lines(c, F.col("heuristic_type")).alias("heuristic_lines"))
    assert as_rows(line_table.baseline_facts(lines, segment)) == as_rows(want)


def test_logs_without_lines_are_empty_texts(spark):
    logs = noisy(spark).limit(3).drop("log_content")
    none = spark.createDataFrame([], "log_id string, line_no long, line string")
    assert {(r.reason, r.signature, r.priority) for r in line_table.triaged(logs, none).collect()} == {("too_short", triage.NO_ERRORS, "low")}
    assert line_table.baseline_facts(none).count() == 0 and line_table.triage_facts(none).count() == 0
