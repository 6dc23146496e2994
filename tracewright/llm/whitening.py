"""Embedding whitening with refined eigenvectors.

Vectors are put on a whole-number grid, so that their count, sums and second moments are exact sums
that Spark adds up in any order. The covariance is exact up to its last rounding. Its eigenvectors
start in float32; Ogita-Aishima steps, matrix products only, then correct them first in double and
then in extended precision, doubling the right digits each time. Where eigenvalues lie closer
together than a step can tell apart, the step refines the space they span and a small eigenproblem
inside that space, shifted to its mean, separates them.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


COMPONENTS = 32
# The grid.
GRID, SHIFT = 64.0, 1_000_000
# Entries beyond this are no grid points: their squares would leave a double's whole numbers.
LARGEST = float(1 << 40)
_STEPS = 12
# Eigenvalues below this share of the largest are rounding of zero.
_RANK = 1e-13
_ROWS = 4096


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is neither null nor holds a null, non-finite or huge (``LARGEST``) entry."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) <= LARGEST))
    return df.filter(F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False)))


def _grid(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """One row a vector, on the grid, without the shift."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * GRID).astype(np.int64).reshape(-1, dims)


def _whole(values) -> pa.Array:
    return pa.array([str(int(v)) for v in values], pa.string())


def _shapes(rows: DataFrame) -> tuple[int, int]:
    """Length that most vectors have (the smallest of ties) and their number."""
    found = rows.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n")).filter("dims > 0")
    top = found.orderBy(F.desc("n"), "dims").limit(1).first()
    return (top.dims, top.n) if top else (0, 0)


def _sums(rows: DataFrame, dims: int) -> list[int]:
    """Exact sum of each dimension on the grid; one row a task and dimension."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims, object)
        for batch in batches:
            x = _grid(batch, dims)
            for at in range(0, len(x), _ROWS):
                total += x[at : at + _ROWS].sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims), pa.int32()), _whole(total)], ["i", "s"])

    parts = rows.select("vector").mapInArrow(summed, "i int, s string")
    found = {r.i: int(r.s) for r in parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return [found[i] for i in range(dims)]


def _product(y: np.ndarray) -> np.ndarray:
    """y'y in whole numbers: by doubles while every sum stays below 2 ** 53, else in Python's."""
    top = int(np.abs(y).max(initial=0))
    if top * top * len(y) < 1 << 53:
        z = y.astype(np.float64)
        return (z.T @ z).astype(np.int64).astype(object)
    z = y.astype(object)
    return z.T @ z


def _moments(rows: DataFrame, dims: int, centre: list[int]) -> list[list[int]]:
    """Exact second moments about a whole centre; one row a task and entry of the upper triangle."""
    upper = np.triu_indices(dims)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, q = np.zeros((dims, dims), object), np.array(centre, np.int64)
        for batch in batches:
            y = _grid(batch, dims) - q
            for at in range(0, len(y), _ROWS):
                total += _product(y[at : at + _ROWS])
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), _whole(total[upper])], ["i", "j", "s"]
        )

    parts = rows.select("vector").mapInArrow(summed, "i int, j int, s string")
    out = [[0] * dims for _ in range(dims)]
    # As many numbers as a covariance has, whatever the number of rows.
    for r in parts.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        out[r.i][r.j] = out[r.j][r.i] = int(r.s)
    return out


def covariance(moments: list[list[int]], sums: list[int], n: int) -> list[list[Fraction]]:
    """Exact covariance from moments and sums about one centre."""
    return [[Fraction(n * m - a * b, n * n) for m, b in zip(row, sums)] for row, a in zip(moments, sums)]


def _extended(v: Fraction) -> np.longdouble:
    """``v`` in extended precision: the nearest double and what is left of it."""
    head = float(v)
    return np.longdouble(head) + np.longdouble(float(v - Fraction(head)))


def _clusters(values: np.ndarray, width: float) -> list[np.ndarray]:
    """Places of neighbouring values (falling) that lie within ``width`` of the next, two or more together."""
    cuts = np.flatnonzero(-np.diff(values) > width) + 1
    return [c for c in np.split(np.arange(len(values)), cuts) if len(c) > 1]


def _step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One correction of approximate eigenvectors ``x`` of ``a``: new vectors, the values of ``x``, and how far ``x`` is off."""
    r = np.eye(len(a), dtype=x.dtype) - x.T @ x
    s = x.T @ (a @ x)
    # Halves that differ by rounding would be blown up by small gaps.
    r, s = (r + r.T) / 2, (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    width = float(2 * (np.linalg.norm(off.astype(np.float64)) + np.abs(values).max() * np.linalg.norm(r.astype(np.float64))))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > width
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    np.fill_diagonal(e, np.diag(r) / 2)
    return x + x @ e, values, width


def _sorted(x: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-values, kind="stable")
    return x[:, order], values[order]


def _separated(a: np.ndarray, x: np.ndarray, values: np.ndarray, width: float) -> np.ndarray:
    """``x`` (columns by falling value) turned inside each cluster so that ``a`` is diagonal there."""
    for places in _clusters(values, width):
        part = x[:, places]
        mean = values[places].mean()
        block = part.T @ (a @ part) - mean * (part.T @ part)
        scale = np.abs(block).max()
        if scale == 0:
            continue  # equal to the last digit: any basis of the space is one of eigenvectors
        _, turn = np.linalg.eigh((block / scale).astype(np.float64))
        x[:, places] = part @ turn[:, ::-1].astype(x.dtype)
    return x


def refined_eigen(exact: list[list[Fraction]]) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns, largest entry positive) to double precision."""
    a = np.array([[_extended(v) for v in row] for row in exact], np.longdouble)
    scale = np.abs(a).max()
    if not scale:
        return np.zeros(len(a)), np.eye(len(a))
    a = a / scale
    _, start = np.linalg.eigh(a.astype(np.float32))
    x = start[:, ::-1].astype(np.float64)
    for kind in (np.float64, np.longdouble):
        b, x = a.astype(kind), x.astype(kind)
        least, stale = np.inf, 0
        for _ in range(_STEPS):
            moved, values, width = _step(b, x)
            # Each step squares the error until rounding is all that is left.
            if width < least / 2:
                stale = 0
            else:
                stale += 1
            if width < least:
                least, best = width, _sorted(x, values)
            if stale == 2:
                break
            x = _separated(b, *_sorted(moved, values), width)
        x, values = best
    x = x / np.sqrt((x * x).sum(axis=0))
    x = x * np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(a))])
    return (values * scale).astype(np.float64), x.astype(np.float64)


def _identity_error(rows: DataFrame, dims: int, centre: np.ndarray, rest: np.ndarray, turn: np.ndarray, n: int) -> float:
    """Largest entry of the whitened rows' covariance minus the identity; one row a task and entry."""
    k = turn.shape[1]
    upper = np.triu_indices(k)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, total = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = ((_grid(batch, dims) - centre).astype(np.float64) - rest) @ turn
            products += w.T @ w
            total += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(upper[0], np.full(k, -1)), pa.int32()), pa.array(np.append(upper[1], np.arange(k)), pa.int32()),
             pa.array(np.append(products[upper], total))], ["i", "j", "s"]
        )

    sums = rows.select("vector").mapInArrow(summed, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    got = {(r.i, r.j): r.s / n for r in sums.collect()}
    return max(abs(got[i, j] - got[-1, i] * got[-1, j] - (i == j)) for i, j in zip(*(u.tolist() for u in upper)))


def whitened(df: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per usable row and component: ``key``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Rows are left out whose vector is null, empty, holds a null, non-finite or huge entry (``usable``)
    or has another length than most (the shorter of two equally common ones stays). Components number
    as many as the covariance has rank, ``components`` at most: without variance there are none, and
    no rows. ``deviation`` is null where it does not fit a long. Repeated rows repeat and count, and a
    null ``key`` stays null. An empty table gives an empty one.
    """
    spark = df.sparkSession
    given = usable(df, vector).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    kind = dict(given.dtypes)["key"]
    columns = f"{key} {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    dims, n = _shapes(given)
    if not n:
        return spark.createDataFrame([], columns)
    rows = given.filter(F.size("vector") == dims)
    sums = _sums(rows, dims)
    centre = [s // n for s in sums]
    about = [s - n * q for s, q in zip(sums, centre)]
    exact = covariance(_moments(rows, dims, centre), about, n)
    values, vectors = refined_eigen(exact)
    k = min(components, int((values > _RANK * max(values[0], 0)).sum()))
    if not k:
        return spark.createDataFrame([], columns)
    trace = float(sum(exact[i][i] for i in range(dims)))
    q, rest = np.array(centre, np.int64), np.array([a / n for a in about])
    turn = vectors[:, :k] / np.sqrt(values[:k])
    error = _identity_error(rows, dims, q, rest, turn, n)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _grid(batch, dims) - q
            w = (y.astype(np.float64) - rest) @ turn
            ends = pa.array(np.arange(len(y) + 1) * k, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), _deviations(y, n, about), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], [key, "deviation", "w"]
            )

    out = rows.mapInArrow(projected, f"{key} {kind}, deviation bigint, w array<double>")
    shares = F.array(*[F.lit(float(v) / trace) for v in values[:k]])
    each = out.select(key, "deviation", F.posexplode("w").alias("place", "whitened"))
    return each.select(
        key, (F.col("place") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("place") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )


def _deviations(y: np.ndarray, n: int, about: list[int]) -> pa.Array:
    """Sum over dimensions of (n x - S) ** 2 from grid points about the centre; null beyond a long."""
    top = (int(np.abs(y).max(initial=0)) * n + max(map(abs, about))) ** 2 * y.shape[1]
    if top < 1 << 63:
        z = y * n - np.array(about, np.int64)
        return pa.array((z * z).sum(axis=1))
    z = y.astype(object) * n - np.array(about, object)
    return pa.array([int(v) if v < 1 << 63 else None for v in (z * z).sum(axis=1)], pa.int64())
