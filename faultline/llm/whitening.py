"""Embedding whitening (operator 13): principal directions by a bidiagonal qd solver.

Rows of centred distinct vectors are reduced to one small triangle R by QR, block by block and triangle by triangle, so that
covariances are never formed by squaring.  R is made bidiagonal by Householder reflections; dqds finds its
singular values to full relative accuracy, and a twisted factorisation at each of them gives the direction.

Only R (dims x dims, of any number of rows) and a few sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

COMPONENTS = 4
#: Triangles (or other partial results) that one task puts together.
FAN_IN = 64
EPS = np.finfo(float).eps


# --- the small dense part ---------------------------------------------------------------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """Diagonal and superdiagonal of U^T r V, and the function that applies V, by Householder reflections."""
    a, n, right = np.array(r, float), r.shape[1], []

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.abs(x).max(initial=0)
        if len(x) < 2 or size == 0 or not x[1:].any():
            return None
        v = x / size
        v[0] += np.copysign(np.sqrt(v @ v), v[0])
        return v / np.sqrt(v @ v)

    for k in range(n):
        if (v := reflector(a[k:, k])) is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < n - 2 and (v := reflector(a[k, k + 1 :])) is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            right.append((k + 1, v))

    def back(z: np.ndarray) -> np.ndarray:
        out = np.array(z, float)
        for at, v in reversed(right):
            out[at:] -= 2 * v * (v @ out[at:])
        return out

    return np.diag(a).copy(), np.diag(a, 1).copy(), back


def _dqds_step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """One differential qd transform of L L^T - shift; None if that isn't positive."""
    n = len(q)
    new_q, new_e, d = np.empty(n), np.empty(max(n - 1, 0)), q[0] - shift
    least = d
    for i in range(n - 1):
        if d < 0:
            return None
        new_q[i] = d + e[i]
        if new_q[i] == 0:
            return None
        t = q[i + 1] / new_q[i]
        new_e[i] = e[i] * t
        d = d * t - shift
        least = min(least, d)
    if d < 0:
        return None
    new_q[n - 1] = d
    return new_q, new_e, least


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an unreduced bidiagonal matrix without zeros on its diagonal, falling, by dqds.

    The least value that is left is found first; where its row's off-diagonal is negligible the row goes.
    """
    q, e, done, moved = diagonal**2, above**2, [], 0.0
    q, e = q.copy(), e.copy()
    while len(q) > 1:
        # Split off what is negligible against the values still wanted (they are at least as large as what was moved).
        if e[-1] <= EPS**2 * (moved + q[-1]) or e[-1] == 0:
            done.append(moved + q[-1])
            q, e = q[:-1], e[:-1]
            continue
        b = q[-2] + e[-2] if len(q) > 2 else q[-2]
        trace, product = b + e[-1] + q[-1], b * q[-1]  # of the last two rows
        low = 2 * product / (trace + np.sqrt(max(trace * trace - 4 * product, 0.0)))
        for factor in (1.0, 0.9, 0.5, 0.1, 0.01, 0.0):
            shift = factor * low * (1 - 4 * EPS)
            if moved + shift == moved:
                shift = 0.0
            if (step := _dqds_step(q, e, shift)) is not None:
                q, e = step[0], step[1]
                moved += shift
                break
            if shift == 0:  # zero in place of the least value
                q = np.maximum(q, np.finfo(float).tiny)
                e = np.where(e < np.finfo(float).tiny, 0.0, e)
    if len(q):
        done.append(moved + q[0])
    return np.sort(np.array(done))[::-1]


def twisted_vectors(diagonal: np.ndarray, above: np.ndarray, value: float) -> Iterator[np.ndarray]:
    """Unit vectors near the eigenvector of B^T B at ``value``, by twisted factorisations, the best twist first."""
    n = len(diagonal)
    d, low = diagonal**2, above / diagonal[:-1] if n > 1 else np.zeros(0)
    tiny = EPS * EPS * max(value, d.max())
    down, up = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
    s, p = np.empty(n), np.empty(n)
    s[0] = -value
    for i in range(n - 1):  # stationary, from the top
        plus = d[i] + s[i]
        plus = plus if abs(plus) > tiny else np.copysign(tiny, plus)
        down[i] = d[i] * low[i] / plus
        s[i + 1] = down[i] * low[i] * s[i] - value
    p[n - 1] = d[n - 1] - value
    for i in range(n - 2, -1, -1):  # progressive, from the bottom
        minus = d[i] * low[i] ** 2 + p[i + 1]
        minus = minus if abs(minus) > tiny else np.copysign(tiny, minus)
        up[i] = low[i] * d[i] / minus
        p[i] = p[i + 1] * d[i] / minus - value
    twist = s + p + value
    for r in np.argsort(np.abs(twist), kind="stable"):
        z = np.zeros(n)
        z[r] = 1.0
        for i in range(r - 1, -1, -1):
            z[i] = -down[i] * z[i + 1]
        for i in range(r, n - 1):
            z[i + 1] = -up[i] * z[i]
        size = np.abs(z).max()
        z = z / size if np.isfinite(size) else np.nan_to_num(z / np.finfo(float).max)
        yield z / np.sqrt(z @ z)


def principal(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, right singular vectors in columns) of a square matrix: the ``most`` largest that aren't zero, falling.

    Zero means at most dims x machine epsilon times the largest singular value.
    """
    n = r.shape[1]
    scale = np.abs(r).max(initial=0)
    if scale == 0:
        return np.zeros(0), np.zeros((n, 0))
    a, b, back = bidiagonal(r / scale)
    size = max(np.abs(a).max(), np.abs(b).max(initial=0))
    a = np.where(np.abs(a) < EPS * EPS * size, np.copysign(EPS * EPS * size, a), a)
    cuts = [0, *(i + 1 for i in range(n - 1) if abs(b[i]) <= EPS * EPS * size), n]  # parts that nothing links
    found = [(v, lo, hi) for lo, hi in zip(cuts, cuts[1:], strict=False) for v in squared_singular_values(a[lo:hi], b[lo : hi - 1])]
    found.sort(key=lambda x: -x[0])
    values, vectors = [], []
    for value, lo, hi in found[:most]:
        if value <= (n * EPS) ** 2 * found[0][0]:
            break
        for z in twisted_vectors(a[lo:hi], b[lo : hi - 1], value):
            whole = np.zeros(n)
            whole[lo:hi] = z
            v = back(whole)
            for _ in range(2):  # against those that are almost as large
                for u in vectors:
                    v = v - u * (u @ v)
            if (length := np.sqrt(v @ v)) > 0.1:
                vectors.append(v / length)
                values.append(value * scale**2)
                break
    return np.array(values), np.array(vectors).T if vectors else np.zeros((n, 0))


# --- the rows ---------------------------------------------------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of arrays of one length without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _reduced(parts: DataFrame, together: Callable[[list[np.ndarray]], np.ndarray], name: str) -> np.ndarray | None:
    """One result from partial ones (a column ``part`` of doubles): tasks put ``FAN_IN`` of them together until one is left."""

    def run(batches: Iterator[pa.RecordBatch]):
        own = None
        for batch in batches:
            for part in batch.column(0):
                x = part.values.to_numpy()
                own = x if own is None else together([own, x])
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.list_(pa.float64()))], ["part"])

    left = stored(parts, name)
    n = left.count()
    while n > 1:
        left = stored(left.repartition(-(-n // FAN_IN)).mapInArrow(run, "part array<double>"), name)
        n = left.count()
    row = left.first()
    return None if row is None else np.array(row.part)


def whole_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key`` and x (array of long, floor(256 c)) of the rows whose vector is whole.

    A vector is left out if it is null or empty, holds a null, NaN or an infinity, or has another length than most have (the greater
    of two as frequent).  x saturates at the limits of a long.
    """
    c = F.col(vector)
    usable = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    made = rows.filter(F.coalesce(usable, F.lit(False))).select(F.col(key).alias("vec_id"), F.transform(c, lambda v: F.floor(v.cast("double") * 256)).alias("x"))
    made = stored(made, "vectors")
    sizes = made.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return made if sizes is None else made.filter(F.size("x") == sizes.n)


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """n and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]):
        n, s = 0, None
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(0))
                wide = np.abs(x.astype(float)).max() * len(x) >= 2.0**62
                own = [int(v) for v in (x.astype(object) if wide else x).sum(0)]
                s, n = own if s is None else [a + b for a, b in zip(s, own, strict=True)], n + len(batch)
        if s is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(s)), pa.array(range(len(s)), pa.int32()), pa.array([str(v) for v in s])], ["n", "dim", "s"])

    rows = fit.mapInArrow(run, "n long, dim int, s string").groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect()  # a row for each dimension
    return (rows[0].n, [int(r.s) for r in rows]) if rows else (0, [])


def _triangles(fit: DataFrame, mean: np.ndarray) -> DataFrame:
    """part: the triangle of each task's centred rows, block by block."""
    d = len(mean)

    def run(batches: Iterator[pa.RecordBatch]):
        r = np.zeros((0, d))
        for batch in batches:
            for i in range(0, len(batch), 4096):
                r = np.linalg.qr(np.vstack([r, _matrix(batch.column(0).slice(i, 4096)) - mean]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([np.vstack([r, np.zeros((d - len(r), d))]).ravel()], pa.list_(pa.float64()))], ["part"])

    return fit.mapInArrow(run, "part array<double>")


def _moments(fit: DataFrame, mean: np.ndarray, to: np.ndarray) -> DataFrame:
    """part: rows, means and centred products of each task's whitened vectors."""
    k = to.shape[1]

    def run(batches: Iterator[pa.RecordBatch]):
        own = None
        for batch in batches:
            if len(batch):
                z = (_matrix(batch.column(0)) - mean) @ to
                m = z.mean(0)
                part = np.concatenate([[len(z)], m, ((z - m).T @ (z - m)).ravel()])
                own = part if own is None else _merged([own, part], k)
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.list_(pa.float64()))], ["part"])

    return fit.mapInArrow(run, "part array<double>")


def _merged(parts: list[np.ndarray], k: int) -> np.ndarray:
    """Two of :func:`_moments` as one: each is centred on its own, and their distance comes in by its own product."""
    a, b = parts
    n, gap = a[0] + b[0], b[1 : k + 1] - a[1 : k + 1]
    return np.concatenate([[n], a[1 : k + 1] + gap * b[0] / n, a[k + 1 :] + b[k + 1 :] + (np.outer(gap, gap) * a[0] * b[0] / n).ravel()])


def whiten(rows: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each row's vector in the leading directions of the distinct vectors' covariance, at unit variance.

    Returns ``key``, component (1, 2, ... by falling eigenvalue), n, deviation, whitened, explained and identity_error for each row of
    :func:`whole_vectors` and each component: as many as ``components``, the dimensions and the covariance's rank allow; none
    where all vectors are alike.  deviation (the sum over dimensions of (n x - S)^2, in whole numbers) is null beyond a long.  Rows that
    repeat come out each but count once in the covariance; null keys stay; an empty table gives no rows; other columns aren't read.
    Equal eigenvalues leave their directions free within their span; the signs of directions are free.
    """
    x = whole_vectors(rows, key, vector)
    kind = x.schema["vec_id"].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = stored(x.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "distinct-vectors")
    n, s = _sums(fit)
    mean = np.array([v / n for v in s])
    r = _reduced(_triangles(fit, mean), lambda p: np.linalg.qr(np.vstack([q.reshape(-1, len(s)) for q in p]), mode="r").ravel(), "triangles") if n else None
    values, directions = principal(r.reshape(-1, len(s)), components) if n else (np.zeros(0), np.zeros((0, 0)))
    if not len(values):
        return x.sparkSession.createDataFrame([], schema)
    k = len(values)
    total = float((r**2).sum())
    to = directions * np.sqrt(n / values)
    moments = _reduced(_moments(fit, mean, to), lambda p: _merged(p, k), "moments")
    error = float(np.abs(moments[k + 1 :].reshape(k, k) / moments[0] - np.eye(k)).max())
    explained, squares = values / total, sum(v * v for v in s)

    def run(batches: Iterator[pa.RecordBatch]):
        sums = np.array(s, object)
        for batch in batches:
            own = _matrix(batch.column(1)) if len(batch) else np.zeros((0, len(s)), np.int64)
            z = (own - mean) @ to
            # n^2 |x|^2 - 2 n x.S + |S|^2 in whole numbers, of any size.
            small = np.abs(own.astype(float)).max(initial=0) < 2.0**24 and max(map(abs, s)) < 2.0**36 and len(s) <= 1024
            exact = own if small else own.astype(object)
            norm = (exact * exact).sum(1).astype(object)
            dot = exact @ (np.array(s, np.int64) if small else sums)
            deviation = n * n * norm - 2 * n * dot.astype(object) + squares
            deviation = [v if v < 1 << 63 else None for v in deviation]
            m = len(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n)),
                    pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(z.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.select("vec_id", "x").mapInArrow(run, schema.replace(f"`{key}`", "vec_id", 1)).withColumnRenamed("vec_id", key)
