"""Whitening of embeddings by an exact covariance.

Components become integers, rows are centred as integers (n * x - S), and their products are summed by digit-slice
GEMM: each integer is cut into limbs of LIMB bits, limb matrices are multiplied in float64 BLAS, whose sums stay below
2^53 and so are exact, and the products are recombined as big integers. A task's sums are merged by streams of rows;
the driver gets one d x d matrix, whose eigenvectors are refined in extended precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, with_fields

#: Bits of a limb, and rows of a block: products of limbs, summed over a block, stay below 2^(2 * 20 + 13) = 2^53.
LIMB, BLOCK = 20, 1 << 13
#: Added to the quantised components.
OFFSET = 1_000_000
#: Quantised components beyond this are cut to it, so that x fits 63 bits.
LARGEST = float(1 << 61)
#: Eigenvalues below this share of the largest are those of a direction in which nothing varies.
LEAST_SHARE = 1e-13


class Fit(NamedTuple):
    """n distinct vectors of d dimensions with their sums, the directions (d x k), eigenvalues and their shares of the
    trace, and the largest error of the whitened covariance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    error: float


def usable(vector: Column) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * component) + OFFSET of each component, as long."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(LARGEST)), F.lit(-LARGEST))).cast("long") + OFFSET)


def _blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of at most BLOCK rows, with their vectors as a matrix; all are of one length."""
    for b in batches:
        for s in range(0, b.num_rows, BLOCK):
            part = b.slice(s, BLOCK)
            flat = part.column(column).flatten().to_numpy(zero_copy_only=False)
            yield part, flat.reshape(part.num_rows, -1)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, as int64 where that must fit, else as Python integers."""
    bound = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if bound < 1 << 62:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Float64 matrices z_k of whole numbers below 2^LIMB in size, with y = sum of z_k * 2^(k * LIMB)."""
    out, sign = [], np.where(y < 0, -1, 1)
    rest = np.abs(y)
    while rest.any():
        out.append((rest & ((1 << LIMB) - 1)).astype(np.float64) * sign.astype(np.float64))
        rest = rest >> LIMB
    return out


def gram(y: np.ndarray) -> np.ndarray:
    """y^T y of integers, exact, as Python integers. y has at most BLOCK rows."""
    z = limbs(y)
    out = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for i, a in enumerate(z):
        for j in range(i, len(z)):
            p = (a.T @ z[j]).astype(np.int64).astype(object)
            out += (p if i == j else p + p.T) << (LIMB * (i + j))
    return out


def _merged(rows: DataFrame, field: str) -> DataFrame:
    """rows (i, field: numbers as text) with those of one i summed, entry by entry. A task streams its rows and holds
    one sum for each i that falls to it."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, values in zip(b.column("i").to_pylist(), b.column(field).to_pylist()):
                v = np.array([int(x) for x in values], dtype=object)
                sums[i] = sums[i] + v if i in sums else v
        for i, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([[str(x) for x in v]], pa.list_(pa.string()))], ["i", field])

    return rows.repartition("i").mapInArrow(add, rows.schema)


def _matrix(rows: DataFrame, d: int) -> list[list[int]]:
    out: list[list[int]] = [[]] * d
    for i, v in rows.collect():  # one row a dimension
        out[i] = [int(x) for x in v]
    return out


def _texts(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([[str(x) for x in r] for r in rows], pa.list_(pa.string()))], ["i", "v"])


def integer_sums(points: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of rows of points (x) and the exact sum of each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, dtype=object)
        for _, x in _blocks(batches, "x"):
            n += len(x)
            low = (x & ((1 << 31) - 1)).sum(axis=0).astype(object)
            total = total + low + ((x >> 31).sum(axis=0).astype(object) << 31)
        if n:
            yield _texts(np.array([[n, *total]], dtype=object))

    found = _matrix(_merged(points.mapInArrow(partial, "i int, v array<string>"), "v"), 1)[0]
    return (found[0], found[1:]) if found else (0, [0] * d)


def integer_covariance(points: DataFrame, n: int, sums: list[int]) -> list[list[int]]:
    """The exact sum of y y^T over points (x), with y = n * x - S: n^3 times the covariance."""
    d = len(sums)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, "x"):
            g = gram(centred(x, n, sums))
            total = g if total is None else total + g
        if total is not None:
            yield _texts(total)

    return _matrix(_merged(points.mapInArrow(partial, "i int, v array<string>"), "v"), d)


def principal(cov: list[list[int]], divisor: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors d x k, eigenvalues, shares of the trace) of the integer matrix cov / divisor, falling, k <= most: those
    of directions that vary.

    Float64 eigenvectors are refined twice by Ogita and Aishima's iteration in extended precision, so that small
    eigenvalues are not lost beside large ones. Of each vector the entry of largest size is positive.
    """
    high = np.array([[x / divisor for x in r] for r in cov])
    low = np.array([[_rest(x, divisor, float(h)) for x, h in zip(r, hs)] for r, hs in zip(cov, high)])
    a = high.astype(np.longdouble) + low.astype(np.longdouble)
    values, v = np.linalg.eigh(high)
    values, v = values.astype(np.longdouble), v.astype(np.longdouble)
    for _ in range(2):
        r = np.eye(len(a), dtype=np.longdouble) - v.T @ v
        s = v.T @ a @ v
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        delta = 2 * (np.linalg.norm((off).astype(float)) + np.linalg.norm(high) * np.linalg.norm(r.astype(float)))
        gap = values[None, :] - values[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            e = np.where(np.abs(gap) > delta, (s + values[None, :] * r) / gap, r / 2)
        np.fill_diagonal(e, np.diag(r) / 2)
        v = v + v @ e
    order = np.argsort(-values, kind="stable")
    values, v = values[order], v[:, order]
    k = int(min(most, (values > LEAST_SHARE * max(values[0], 0)).sum() if values[0] > 0 else 0))
    v = v * np.where(v[np.abs(v).argmax(axis=0), range(v.shape[1])] < 0, -1, 1)
    return v[:, :k].astype(float), values[:k].astype(float), (values[:k] / np.trace(a)).astype(float) if k else np.zeros(0)


def _rest(x: int, divisor: int, h: float) -> float:
    """x / divisor - h, rounded once."""
    p, q = h.as_integer_ratio()
    return (x * q - p * divisor) / (divisor * q)


def _whiten(y: np.ndarray, n: int, vectors: np.ndarray, values: np.ndarray) -> np.ndarray:
    """(x - S/n) on each direction, over the root of its eigenvalue."""
    return (y / n).astype(float) @ (vectors / np.sqrt(values))


def identity_error(points: DataFrame, n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray) -> float:
    """The largest absolute entry of the whitened points' covariance minus the identity, measured over all points."""
    k = vectors.shape[1]

    def partial(mean: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((1 if mean is None else k, k))
            for _, x in _blocks(batches, "x"):
                w = _whiten(centred(x, n, sums), n, vectors, values)
                total += w.sum(axis=0)[None, :] if mean is None else (w - mean).T @ (w - mean)
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "v"])

        return run

    def summed(mean: np.ndarray | None) -> np.ndarray:
        out = np.zeros((1 if mean is None else k, k))
        for i, j, v in points.mapInArrow(partial(mean), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():  # k * k rows
            out[i, j] = v
        return out / n

    return float(np.abs(summed(summed(None)[0]) - np.eye(k)).max())


def fit(points: DataFrame, d: int, most: int) -> Fit | None:
    """The whitening of distinct vectors, points (x) of d dimensions; None where nothing varies."""
    n, sums = integer_sums(points, d)
    if n < 2:
        return None
    vectors, values, explained = principal(integer_covariance(points, n, sums), n**3, most)
    if not len(values):
        return None
    return Fit(n, sums, vectors, values, explained, identity_error(points, n, sums, vectors, values))


def whiten(rows: DataFrame, vector: str = "embedding", scale: int = 64, most: int = 16) -> DataFrame:
    """rows' other columns and, for each component up to `most`: component, n, deviation, deviation_text, whitened,
    explained, identity_error.

    The fit is over each distinct quantised vector once, so repeated rows weigh nothing more, and each gets its
    results. Rows whose vector is null, empty or holds null or non-finite components are left out. Vectors of another
    length are in another space: each length has a fit of its own (the lengths that occur are few; a d x d matrix of
    each is on the driver). Directions in which nothing varies are no components: a table of one distinct vector gives
    no rows. deviation is null where it exceeds a long, deviation_text has it in full. Columns that clash with the
    results are called input_<name>.
    """
    results = ["component", "n", "deviation", "deviation_text", "whitened", "explained", "identity_error"]
    clash = {c: fresh([*rows.columns, *results], f"input_{c}")[0] for c in rows.columns if c != vector and c.lower() in results}
    rows = rows.withColumnsRenamed(clash)
    x = fresh([*rows.columns, *results], "x")[0]
    good = rows.filter(usable(F.col(f"`{vector}`"))).withColumn(x, quantised(F.col(f"`{vector}`"), scale)).drop(vector)
    points = materialize(good.select(F.col(x).alias("x")).distinct(), "whitening-fit")
    kept = good.drop(x).schema
    schema = with_fields(kept, "component int, n long, deviation long, deviation_text string, whitened double, explained double, identity_error double")
    out = rows.sparkSession.createDataFrame([], schema)
    for (d,) in points.select(F.size("x").alias("d")).distinct().orderBy("d").collect():
        found = fit(points.filter(F.size("x") == d), d, most)
        if found is not None:
            out = out.unionByName(good.filter(F.size(x) == d).mapInArrow(_apply(found, x, [f.name for f in kept]), schema))
    return out


def _apply(found: Fit, x: str, kept: list[str]):
    n, sums, vectors, values, explained, error = found
    k = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, points in _blocks(batches, x):
            m = part.num_rows
            y = centred(points, n, sums)
            exact = y.dtype == np.int64 and int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 1 << 63
            deviation = (y * y).sum(axis=1) if exact else (y.astype(object) ** 2).sum(axis=1)
            numbers = [int(v) for v in deviation]
            again = np.repeat(np.arange(m), k)
            taken = part.select(kept).take(pa.array(again))
            whitened = _whiten(y, n, vectors, values).ravel()
            of_row = [pa.array([v if v < 1 << 63 else None for v in numbers], pa.int64()).take(pa.array(again)), pa.array([str(v) for v in numbers]).take(pa.array(again))]
            arrays = [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, dtype=np.int64)), *of_row, pa.array(whitened), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays([*taken.columns, *arrays], [*kept, "component", "n", "deviation", "deviation_text", "whitened", "explained", "identity_error"])

    return run
