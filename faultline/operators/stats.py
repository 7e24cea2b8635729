"""Paired tests and intervals from counts: the data is aggregated by Spark, a row for each pair or group gets its tail or draws."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series) -> pd.Series:
    """P(X > x) of a chi-square variable with one degree of freedom."""
    return x.map(lambda v: math.erfc(math.sqrt(v / 2)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = c if abs(c) > 1e-300 else 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|) of Student's t."""
    if not math.isfinite(t) or df <= 0:
        return math.nan
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(DoubleType())
def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) for a, b in zip(t, df, strict=True)])


def mcnemar(pairs: DataFrame) -> DataFrame:
    """Adds chi2, p_value, significant (p < 0.05) and verdict to rows with n10 and n01."""
    d = F.col("n10") + F.col("n01")
    chi2 = F.coalesce(F.try_divide(F.pow(F.abs(F.col("n01") - F.col("n10")) - F.lit(1.0), F.lit(2)), d), F.lit(0.0))
    out = pairs.withColumn("chi2", chi2).withColumn("p_value", F.when(d == 0, F.lit(1.0)).otherwise(chi2_tail("chi2")))
    verdict = F.when(d == 0, "identical").when(F.col("p_value") < 0.05, "different").otherwise("no significant difference")
    return out.withColumn("significant", F.col("p_value") < 0.05).withColumn("verdict", verdict)


def _seed(*parts) -> np.random.Generator:
    return np.random.default_rng([int(p) & 0xFFFFFFFF for p in parts])


def bootstrap_accuracy(groups: DataFrame, key: str, resamples: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """key, observed, lower, upper from groups (key, n, right): a resample's hits are binomial, drawn from its own seed."""

    def draw(frames):
        for f in frames:
            rows = []
            for k, n, right in zip(f[key], f["n"], f["right"], strict=True):
                p = right / n if n else 0.0
                x = _seed(seed, n, right).binomial(n, p, resamples) / n if n else np.zeros(resamples)
                rows.append((k, p, *np.quantile(x, [(1 - level) / 2, (1 + level) / 2])))
            yield pd.DataFrame(rows, columns=[key, "observed", "lower", "upper"])

    return groups.select(key, "n", "right").mapInPandas(draw, f"`{key}` {groups.schema[key].dataType.simpleString()}, observed double, lower double, upper double")


#: A Poisson(1) weight is the number of these limits, its distribution's, that a uniform value reaches.
POISSON_LIMITS = [float(round(x, 12)) for x in np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])]


def bootstrap_metric(rows: DataFrame, weighted, keys: list[str], resamples: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """observed, lower, upper of any weighted aggregate: ``weighted(weight column)`` over the rows, and over Poisson weights of each replicate.

    Every row comes out once for each replicate; what is a function of sums is better asked of :func:`bootstrap_sums`.

    A row's weight in a replicate follows from its ``keys``, so draws don't depend on partitions.
    """
    name = F.concat_ws(":", *(F.col(k).cast("string") for k in keys), F.col("replicate").cast("string"), F.lit(str(seed)))
    u = F.conv(F.substring(F.md5(name.cast("binary")), 1, 7), 16, 10).cast("bigint") / float(1 << 28)
    drawn = rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("u", u)
    drawn = drawn.withColumn("weight", sum((F.when(F.col("u") >= x, 1).otherwise(0) for x in POISSON_LIMITS), F.lit(0)))
    values = drawn.groupBy("replicate").agg(weighted(F.col("weight")).alias("v"))
    limits = values.agg(F.percentile("v", F.lit((1 - level) / 2)).alias("lower"), F.percentile("v", F.lit((1 + level) / 2)).alias("upper"))
    return rows.agg(weighted(F.lit(1)).alias("observed")).crossJoin(F.broadcast(limits))  # one row each


#: A row's draw in a replicate is (hash * a + b) modulo this prime, a and b those of the replicate: draws of two rows are independent.
PRIME = (1 << 31) - 1
#: The draws from which on a weight is 1, 2, ...
WEIGHT_FROM = [math.ceil(x * PRIME) for x in POISSON_LIMITS]


def replicate_factors(replicate: int, seed: int) -> tuple[int, int]:
    """a and b of a replicate: 28 bits each of a digest of its number."""
    digest = md5(f"{seed}:{replicate}".encode()).hexdigest()
    return int(digest[:7], 16) + 1, int(digest[7:14], 16)


def bootstrap_sums(rows: DataFrame, sums: dict[str, Column], metric: Callable[[dict[str, Column]], Column], keys: list[str], resamples: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """observed, lower, upper of a metric that is a function of ``sums`` over the rows, by Poisson weights of ``resamples`` replicates.

    A task adds up an array for each sum, with a place for each replicate; arrays are merged place by place, so what is moved
    doesn't grow with the rows.  A row's weights follow from its ``keys``, so draws don't depend on partitions; rows with equal keys weigh alike, a null
    counts as 0 in a sum, and without rows all three are null.
    """
    names = list(sums)
    text = F.concat_ws(":", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys), F.lit(str(seed)))
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long")
    used = rows.select(h.alias("h"), *(F.coalesce(sums[n].cast("double"), F.lit(0.0)).alias(f"s{i}") for i, n in enumerate(names)))
    a, b = np.array([replicate_factors(r, seed) for r in range(1, resamples + 1)], np.int64).T

    def run(batches: Iterator[pa.RecordBatch]):
        own = np.zeros((len(names), resamples + 1))
        for batch in batches:
            hashes, values = np.asarray(batch.column(0)), np.stack([np.asarray(c) for c in batch.columns[1:]])
            own[:, 0] += values.sum(1)  # place 0: as observed
            for i in range(0, len(hashes), 1024):
                drawn = (hashes[i : i + 1024, None] * a + b) % PRIME
                own[:, 1:] += values[:, i : i + 1024] @ np.searchsorted(WEIGHT_FROM, drawn, "right").astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(own.tolist(), pa.list_(pa.float64())), pa.array(range(len(names)), pa.int32())], ["part", "name"])

    parts = used.mapInArrow(run, "part array<double>, name int").select("name", F.posexplode("part").alias("replicate", "v"))
    merged = parts.groupBy("name", "replicate").agg(F.sum("v").alias("v"))
    values = merged.groupBy("replicate").agg(*(F.max(F.when(F.col("name") == i, F.col("v"))).alias(f"s{i}") for i in range(len(names))))
    values = values.select("replicate", metric({n: F.col(f"s{i}") for i, n in enumerate(names)}).alias("v"))
    drawn = F.when(F.col("replicate") > 0, F.col("v"))
    return values.agg(F.max(F.when(F.col("replicate") == 0, F.col("v"))).alias("observed"), F.percentile(drawn, F.lit((1 - level) / 2)).alias("lower"), F.percentile(drawn, F.lit((1 + level) / 2)).alias("upper"))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of x >= 1, to about 1e-15 of its size: Stirling's series at x + 8, and back by recurrence."""
    z = x + 8
    w = 1 / (z * z)
    # The series' coefficients
    series = (1 / 12 + w * (-1 / 360 + w * (1 / 1260 + w * (-1 / 1680 + w * (1 / 1188 + w * (-691 / 360360)))))) / z
    back = sum((F.ln(x + i) for i in range(1, 8)), F.ln(x))
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - back


def sign_test_p(n10: Column, n01: Column) -> Column:
    """The exact two-sided p of n10 against n01 fair draws: the probability to be at least as far apart; 1 where they are alike.

    Twice the binomial's lower tail.  Its last term is taken in logarithms, the others by their ratios to it; those more than
    10 standard deviations off are below 1e-80 of it.
    """
    m, k = (n10 + n01).cast("double"), F.least(n10, n01).cast("double")
    last = F.exp(log_gamma(m + 1) - log_gamma(k + 1) - log_gamma(m - k + 1) - m * math.log(2))
    terms = F.least(k, F.ceil(10 * F.sqrt(m)) + 50).cast("int")
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(acc: Column, j: Column) -> Column:
        t = acc["t"] * (k - j + 1) / (m - k + j)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    tail = F.aggregate(F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>")), start, step, lambda acc: acc["s"])
    return F.when(n10 == n01, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * last * tail))


def exact_tests(pairs: DataFrame) -> DataFrame:
    """Adds difference and exact_p to rows with n, n10, n01, right_a, right_b: what sign flips and McNemar's test of few discordant logs tend to."""
    return pairs.withColumn("difference", F.try_divide(F.col("right_a") - F.col("right_b"), F.col("n"))).withColumn("exact_p", sign_test_p(F.col("n10"), F.col("n01")))


def permutation(pairs: DataFrame, flips: int = 10_000, seed: int = 42) -> DataFrame:
    """Adds difference, p_value (share of sign flips at least as far apart, in whole counts) to rows with n, n10, n01, right_a, right_b."""

    @F.pandas_udf(DoubleType())
    def share(n10: pd.Series, n01: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(n10, n01, strict=True):
            m = int(a + b)
            s = 2 * _seed(seed, a, b).binomial(m, 0.5, flips) - m
            out.append(float(np.mean(np.abs(s) >= abs(int(a - b)))))
        return pd.Series(out)

    return pairs.withColumn("difference", (F.col("right_a") - F.col("right_b")) / F.col("n")).withColumn("p_value", share("n10", "n01"))
