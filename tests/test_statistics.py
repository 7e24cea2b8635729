"""Tails, exact tests and resampling against sums and integrals."""

import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import stats
from faultline.plans.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"


def exact(a, b):
    m, d = a + b, abs(a - b)
    return float(Fraction(sum(math.comb(m, k) for k in range(m + 1) if abs(2 * k - m) >= d), 2**m))


def test_sign_test_equals_the_binomial(spark):
    cases = [(0, 0), (1, 0), (0, 1), (5, 5), (2, 1), (12, 3), (30, 12), (0, 60), (100, 131), (511, 513), (900, 1100), (3, 2000)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, n10 long, n01 long")
    got = {r.i: r.p for r in df.select("i", stats.sign_test_p(F.col("n10"), F.col("n01")).alias("p")).collect()}
    for i, (a, b) in enumerate(cases):
        assert got[i] == pytest.approx(exact(a, b), rel=1e-9)
    large = spark.createDataFrame([(1_000_000, 998_000)], "n10 long, n01 long").select(stats.sign_test_p(F.col("n10"), F.col("n01")).alias("p")).first().p
    z = (2000 - 1) / math.sqrt(1_998_000)
    assert large == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)


def test_log_gamma(spark):
    xs = [1.0, 1.5, 2.0, 3.7, 10.0, 123.0, 1e4, 1e7]
    got = [r.g for r in spark.createDataFrame([(x,) for x in xs], "x double").select(stats.log_gamma(F.col("x")).alias("g")).collect()]
    for x, g in zip(xs, got, strict=True):
        assert g == pytest.approx(math.lgamma(x), rel=1e-14, abs=2e-14)


def simpson(f, a, b, n=20_000):
    x = np.linspace(a, b, n + 1)
    w = np.ones(n + 1)
    w[1:-1:2], w[2:-1:2] = 4, 2
    return float((w * f(x)).sum() * (b - a) / n / 3)


def test_tails_against_integrals(spark):
    ts, dfs = [0.0, 0.3, 1.0, 2.0, 3.5, 6.0, -2.0], [1, 2, 3, 7, 30, 200, 14_998]
    rows = [(t, float(v)) for t in ts for v in dfs]
    got = [r.p for r in spark.createDataFrame(rows, "t double, df double").select(stats.t_tail("t", "df").alias("p")).collect()]
    for (t, v), p in zip(rows, got, strict=True):
        f = lambda x, v=v: np.cos(x) ** (v - 1)
        at = math.atan(abs(t) / math.sqrt(v))
        assert p == pytest.approx(simpson(f, at, math.pi / 2) / simpson(f, 0, math.pi / 2), abs=1e-9)
    assert stats.t_two_sided(3.0, 1) == pytest.approx(1 - 2 / math.pi * math.atan(3.0), abs=1e-14) and stats.t_two_sided(3.0, 2) == pytest.approx(1 - 3 / math.sqrt(11), abs=1e-14)
    xs = [0.0, 0.01, 0.25, 1.0, 3.841458820694124, 10.0, 25.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").select(stats.chi2_tail("x").alias("p")).collect()]
    for x, p in zip(xs, got, strict=True):
        assert p == pytest.approx(1 - 2 * simpson(lambda y: np.exp(-y * y / 2) / math.sqrt(2 * math.pi), 0, math.sqrt(x)), abs=1e-9)
    assert got[4] == pytest.approx(0.05, abs=1e-9)


def test_replicates_are_sums_of_drawn_weights(spark):
    rows = [(f"r{i}", float(i % 17), i % 3 == 0) for i in range(500)] + [("r3", None, None)]
    df = spark.createDataFrame(rows, "k string, x double, ok boolean")
    sums = {"x": F.col("x"), "n": F.lit(1)}
    mean = lambda s: s["x"] / s["n"]
    got = stats.bootstrap_sums(df.repartition(7), sums, mean, ["k"], resamples=300).first()
    import hashlib

    values = []
    for r in range(1, 301):
        a, b = stats.replicate_factors(r, 42)
        w = [sum((int(hashlib.md5(f"{k}:42".encode()).hexdigest()[:7], 16) * a + b) % stats.PRIME >= x for x in stats.WEIGHT_FROM) for k, _, _ in rows]
        values.append(sum(n * (x or 0) for n, (_, x, _) in zip(w, rows, strict=True)) / sum(w))
    assert got.observed == pytest.approx(sum(x or 0 for _, x, _ in rows) / 501)
    assert (got.lower, got.upper) == tuple(pytest.approx(np.quantile(values, q)) for q in (0.025, 0.975))
    again = stats.bootstrap_sums(df.repartition(2), sums, mean, ["k"], resamples=300).first()
    assert tuple(again) == tuple(pytest.approx(v) for v in got)
    assert tuple(stats.bootstrap_sums(df.limit(0), sums, lambda s: F.try_divide(s["x"], s["n"]), ["k"], resamples=10).first()) == (None,) * 3


def test_interval_covers_as_the_normal_one(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(5, 2, 4000)
    df = spark.createDataFrame([(f"i{i}", float(v)) for i, v in enumerate(x)], "k string, x double")
    got = stats.bootstrap_sums(df, {"x": F.col("x"), "n": F.lit(1)}, lambda s: s["x"] / s["n"], ["k"]).first()
    half = 1.96 * x.std() / math.sqrt(len(x))
    assert got.lower == pytest.approx(x.mean() - half, abs=0.15 * half) and got.upper == pytest.approx(x.mean() + half, abs=0.15 * half)


def test_what_is_moved_does_not_grow_with_rows(spark):
    for n in (1000, 20_000):
        df = spark.range(n).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).alias("x")).repartition(3)
        made = stats.bootstrap_sums(df, {"x": F.col("x")}, lambda s: s["x"], ["k"], resamples=50)
        assert made.first().observed == sum(i % 7 for i in range(n))
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Explode" not in plan.split("MapInArrow")[-1]  # rows aren't multiplied below the task's arrays


@pytest.mark.parametrize("name", ["e17_metric", "e18_exact", "e16_exact_by_type"])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("orders", "customer"):
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    got = c.execute(ORACLES[name])
    names = [x[0] for x in got.description]
    show = lambda v: f"{v:.5g}" if isinstance(v, float) else str(v)
    want = sorted(str([show(v) for _, v in sorted(zip(names, r, strict=True))]) for r in got.fetchall())
    assert sorted(str([show(r[k]) for k in sorted(names)]) for r in QUERIES[name](spark, D).collect()) == want and want
