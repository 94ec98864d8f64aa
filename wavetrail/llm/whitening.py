"""Embedding whitening by spectral divide and conquer on polar decompositions.

An entry c becomes the integer x = floor(64 c) + 1000000. A task sums its integers and their products
exactly (float64 products of limbs small enough to be exact, then Python integers); Spark adds the sums
of all tasks. The covariance numerator sum((n x - S)(n x - S)') / n = n sum(x x') - S S' is therefore
that of centred values without a rounding: only the last division rounds.

The d x d covariance (d is the dimension, so this does not grow with the rows) is split on the driver:
the polar factor U of V - shift I, by the QR form of the QDWH iteration, is +1 on eigenvalues above the
shift and -1 below, so (I + U) / 2 projects on an invariant subspace. Bases of both subspaces give two
smaller matrices, which are split in turn until single components are left; only the upper part is
followed once it has as many components as wanted. The components and 1 / sqrt(e) are broadcast.

Defined results: vectors that are null or hold null or non-finite entries are dropped, also those
whose length is not the most frequent one (of equally frequent lengths the longest). Entries beyond
+-2^56 count as +-2^56. Components whose eigenvalue is not above d * 2^-52 of the largest one have no
scale: they are left out, so vectors that are all equal, a single vector and an empty table give no
rows. Rows with the same id, or without one, are rows of their own; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Bits of a limb and rows of one product: 2 * 20 + 12 bits are exact in a double.
LIMB, ROWS = 20, 1 << 12
_EPS = 2.0**-52
_END = 1 << 62


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """`vec_id`, `v`: rows whose vector has no null and no non-finite entry, of the most frequent length."""
    v = F.col(column).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(v.isNotNull() & sound)
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (length["d"] if length else 0))


def integers(column: pa.Array, d: int) -> np.ndarray:
    """floor(64 c) of each entry: shape (rows, d)."""
    c = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.clip(np.floor(np.clip(c, -(2.0**56), 2.0**56) * SCALE), -_END, _END).astype(np.int64)


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """y = sum of limb k * 2^(20 k), limbs as doubles below 2^20."""
    out = []
    while True:
        if np.abs(y).max(initial=0) < 1 << LIMB:
            return [*out, y.astype(float)]
        low = y & (1 << LIMB) - 1
        out.append(low.astype(float))
        y = y >> LIMB


def products(y: np.ndarray) -> np.ndarray:
    """y' y exactly, as Python integers."""
    total = np.zeros((y.shape[1],) * 2, object)
    for low in range(0, len(y), ROWS):
        limbs = _limbs(y[low : low + ROWS])
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) << LIMB * (i + j)
    return total


def _digits(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Digits of 32 bits of Python integers, with their sign: (place, digits)."""
    rest, sign, k = np.abs(values), np.where(values < 0, -1, 1), 0
    while k == 0 or rest.any():
        yield k, (rest & 0xFFFFFFFF).astype(np.int64) * sign.astype(np.int64)
        rest, k = rest >> 32, k + 1


def _sums(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """Number of rows, sums and products of one task in digits: rows (i, j, place, value), -1 for a one."""
    n, s, g = 0, np.zeros(d, object), np.zeros((d, d), object)
    for batch in batches:
        y = integers(batch.column(1), d)
        n, s, g = n + len(y), s + y.astype(object).sum(0), g + products(y)
    i, j = np.triu_indices(d)
    rows, columns = np.r_[-1, np.full(d, -1), i], np.r_[-1, np.arange(d), j]
    for place, value in _digits(np.concatenate([np.array([n], object), s, g[i, j]])):
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(columns.astype(np.int32)), pa.array(np.full(len(rows), place, np.int32)), pa.array(value)], ["i", "j", "place", "value"])


def moments(rows: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, sums and products of floor(64 c), exact; d (d + 3) / 2 + 1 numbers reach the driver."""
    parts = rows.mapInArrow(lambda it: _sums(it, d), "i int, j int, place int, value long")
    n, s, g = 0, np.zeros(d, object), np.zeros((d, d), object)
    for r in parts.groupBy("i", "j", "place").agg(F.sum("value").alias("value")).collect():
        value = r["value"] << 32 * r["place"]
        if r["j"] < 0:
            n += value
        elif r["i"] < 0:
            s[r["j"]] += value
        else:
            g[r["i"], r["j"]] += value
    return n, s, g + np.triu(g, 1).T


# --- spectral divide and conquer -----------------------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by the QR-based dynamically weighted Halley iteration."""
    n = len(a)
    x, low, eye = a / np.linalg.norm(a), _EPS, np.eye(n)
    for _ in range(12):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        root = math.sqrt(1 + d)
        p = root + 0.5 * math.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        both = np.linalg.qr(np.vstack([math.sqrt(r) * x, eye]))[0]
        after = q / r * x + (p - q / r) / math.sqrt(r) * (both[:n] @ both[n:].T)
        after = (after + after.T) / 2
        moved, x = np.linalg.norm(after - x), after
        low = min(1.0, low * (p + q * square) / (1 + r * square))
        if moved < 10 * _EPS * math.sqrt(n) or (low >= 1 - 4 * _EPS and moved < 1e-9):
            break
        low = min(low, 1 - _EPS)
    return x


def _subspaces(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces, upper eigenvalues first; None if all eigenvalues are one."""
    n, size = len(a), np.linalg.norm(a)
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n))
    if spread <= n * _EPS * size:
        return None
    rng = np.random.default_rng(n)
    shifts = [float(np.median(np.diag(a))), mean, *(mean + spread / math.sqrt(n) * rng.uniform(-0.3, 0.3, 12))]
    for shift in shifts:
        u = polar(a - shift * np.eye(n))
        k = round((n + np.trace(u)) / 2)
        if not 0 < k < n or np.linalg.norm(u @ u - np.eye(n)) > 1e-10 * n:
            continue  # all on one side, or the shift is an eigenvalue
        projector, basis = (np.eye(n) + u) / 2, rng.standard_normal((n, k))
        for _ in range(3):
            basis = np.linalg.qr(projector @ basis[:, :k], mode="complete")[0]
        upper, lower = basis[:, :k], basis[:, k:]
        if np.linalg.norm(lower.T @ a @ upper) <= 100 * n * _EPS * size:
            return upper, lower
    return None


def components(v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    found: list[np.ndarray] = []

    def divide(a: np.ndarray, basis: np.ndarray) -> None:
        if len(found) >= wanted:
            return
        parts = _subspaces(a) if len(a) > 1 else None
        if parts is None:
            found.extend(basis.T)
            return
        for part in parts:
            own = part.T @ a @ part
            divide((own + own.T) / 2, basis @ part)

    divide(v, np.eye(len(v)))
    vectors = np.linalg.qr(np.stack(found, 1))[0]
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], vectors[:, order]


# --- whitening ---------------------------------------------------------------------------------------


class Whitener:
    """Mean, components and scales of a fit list."""

    def __init__(self, n: int, s: np.ndarray, g: np.ndarray, wanted: int = COMPONENTS):
        self.n, self.s, d = n, s, len(s)
        exact = n * g - np.outer(s, s)
        v = np.array([[int(x) / n**2 for x in row] for row in exact], float).reshape(d, d)
        values, vectors = components(v, min(wanted, d))
        keep = values > d * _EPS * max(values.max(initial=0.0), 0.0)
        self.values, self.weights = values[keep], vectors[:, keep] / np.sqrt(values[keep])
        trace = sum(int(exact[i, i]) for i in range(d)) / n**2
        self.explained = self.values / trace if trace else self.values

    def rows(self, column: pa.Array) -> tuple[list[int], np.ndarray]:
        """sum((n x - S)^2), exact, and the whitened components of each row."""
        y, d = integers(column, len(self.s)), len(self.s)
        most = self.n * (int(np.abs(y).max(initial=0)) + 1) + max((abs(int(x)) for x in self.s), default=0)
        apart = self.n * y.astype(object) - self.s if most * most * d >= 1 << 63 else self.n * y - self.s.astype(np.int64)
        return (apart * apart).sum(1).tolist(), (apart.astype(float) / self.n) @ self.weights


def fit(rows: DataFrame, wanted: int = COMPONENTS) -> Whitener | None:
    """The whitener of `rows(vec_id, v)` of one length; None without rows."""
    first = rows.first()
    if first is None or not len(first["v"]):
        return None
    return Whitener(*moments(rows, len(first["v"])), wanted)


def _spread(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Sums and centred products of the whitened rows of one task, moved to a centre of zero."""
    held = model.value
    k = held.weights.shape[1]
    n, mean, m2 = 0, np.zeros(k), np.zeros((k, k))
    for batch in batches:
        w = held.rows(batch.column(1))[1]
        if len(w):
            own = w.mean(0)
            apart, step, total = w - own, own - mean, n + len(w)
            m2 += apart.T @ apart + np.outer(step, step) * n * len(w) / total
            mean, n = mean + step * len(w) / total, total
    i, j = np.triu_indices(k)
    value = np.r_[n * mean, (m2 + n * np.outer(mean, mean))[i, j]]
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.full(k, -1), i].astype(np.int32)), pa.array(np.r_[np.arange(k), j].astype(np.int32)), pa.array(value)], ["i", "j", "value"])


def identity_error(rows: DataFrame, model) -> float:
    """The largest absolute entry of (covariance of the whitened rows - identity)."""
    held = model.value
    k, n = held.weights.shape[1], held.n
    mean, m2 = np.zeros(k), np.zeros((k, k))
    for r in rows.mapInArrow(lambda it: _spread(it, model), "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        if r["i"] < 0:
            mean[r["j"]] = r["value"] / n
        else:
            m2[r["i"], r["j"]] = m2[r["j"], r["i"]] = r["value"]
    return float(np.abs(m2 / n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def _whitened(batches: Iterator[pa.RecordBatch], model, error: float) -> Iterator[pa.RecordBatch]:
    held = model.value
    k = held.weights.shape[1]
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            part = batch.slice(low, ROWS)
            deviation, w = held.rows(part.column(1))
            n = part.num_rows
            decimal = pa.array([x if x < 10**38 else None for x in deviation], pa.decimal128(38, 0))
            row = pa.array(np.repeat(np.arange(n), k))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(row), pa.array(np.tile(np.arange(1, k + 1), n).astype(np.int32)), pa.array(np.full(n * k, held.n)), decimal.take(row),
                 pa.array(w.ravel()), pa.array(np.tile(held.explained, n)), pa.array(np.full(n * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(vectors: DataFrame, column: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """Per usable row and component: `vec_id`, `component`, `n`, `deviation`, `whitened`, `explained`, `identity_error`.

    `deviation` is exact; it is null beyond 38 digits.
    """
    spark, rows = vectors.sparkSession, usable(vectors, column)
    found = fit(rows, wanted)
    if found is None or not len(found.values):
        return spark.createDataFrame([], SCHEMA)
    model = spark.sparkContext.broadcast(found)
    error = identity_error(rows, model)
    return rows.mapInArrow(lambda it: _whitened(it, model, error), SCHEMA)


def whitening_report(vectors: DataFrame) -> DataFrame:
    """`whiten` with `deviation` as long (null where it does not fit)."""
    return whiten(vectors).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
