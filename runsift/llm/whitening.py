"""Whitening of vectors: principal components of unit variance, with refined eigenvectors.

Components become whole numbers, so that sums and products of all partitions add up exactly,
whatever their order. The covariance is taken over the distinct vectors. Their values are centred
by the whole part of the mean before they are multiplied; the fraction that is left is taken off
in exact integers.

The eigenvectors start as those of the covariance in float32 and are corrected by Ogita-Aishima
iterations, matrix products in extended precision, until they stand still. Eigenvalues too close
to be told apart share a subspace at first; a small eigenproblem on that subspace, with the shift
taken off, parts them, and the iterations go on.

Vectors that are null or hold null or non-finite components take no part. Shorter vectors go on
with zeros. There are as many components as the rank of the covariance, at most `components`; one
vector, or none, gives no rows. Rows with a null key, and rows that repeat, stay. Values beyond
2^31 are not defined; a deviation that passes 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.llm.common import written

#: Scale and offset of the whole numbers.
SCALE, OFFSET = 64, 1_000_000
#: Corrections at most, and eigenvalues of the trace that count as zero.
ROUNDS, ZERO = 30, 1e-13


def whole(vector: Column) -> Column:
    """floor(SCALE * x) + OFFSET of every component; null for a vector that takes no part."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("bigint") + OFFSET))


def corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One Ogita-Aishima step: better eigenvectors x of a, their values, and the distance below
    which two of these could not be told apart."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ a @ x
    values = np.diag(s) / (1 - np.diag(r))
    size = lambda m: float(np.sqrt((m * m).sum()))  # noqa: E731  (bounds the spectral norm)
    apart = 2 * (size(s - np.diag(values)) + size(a) * size(r))
    gap = values[None, :] - values[:, None]
    close = np.abs(gap) <= apart
    e = np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, gap))
    return x + x @ e, values, apart


def clusters(values: np.ndarray, apart: float) -> list[np.ndarray]:
    """Places of eigenvalues with neighbours within `apart`."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order].astype(float)) > apart) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def eigen(matrix: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest and their unit eigenvectors (columns) of a symmetric matrix in
    extended precision; the largest entry of each vector is positive."""
    a = matrix.astype(np.longdouble)
    scale = np.abs(a).max(initial=0) or np.longdouble(1)
    a = a / scale
    _, start = np.linalg.eigh(a.astype(np.float32))
    x = start.astype(np.longdouble)
    tiny = float(np.finfo(np.longdouble).eps) * len(a)
    values, last = np.diag(a), np.inf
    for _ in range(rounds):
        x, values, apart = corrected(a, x)
        # Where a cluster cannot be told apart, its subspace is right but not the vectors in it.
        for group in clusters(values, apart):
            part = x[:, group]
            middle = values[group].mean()
            small = part.T @ (a @ part - middle * part)
            width = np.abs(small).max()
            if width <= tiny:
                continue  # equal eigenvalues: any basis will do
            _, turn = np.linalg.eigh(((small + small.T) / (2 * width)).astype(np.float64))
            x[:, group] = part @ turn.astype(np.longdouble)
        moved = float(np.abs(a @ x - x * values).max()) + float(np.abs(x.T @ x - np.eye(len(a))).max())
        if moved <= 4 * tiny or (moved < 1e-15 and moved >= last):
            break
        last = moved
    # Rounding between close eigenvalues leaves a trace in the angles; these two steps only
    # straighten them.
    for _ in range(2):
        x = x + x @ (np.eye(len(a), dtype=a.dtype) - x.T @ x) / 2
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values.astype(float), kind="stable")
    x, values = x[:, order], values[order] * scale
    signs = np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(a))])
    return values, x * np.where(signs == 0, 1, signs)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers; shorter ones go on with the number of zero."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(len(column), width)
    out = np.full((len(column), width), OFFSET, np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), at] = flat
    return out


def _sums(rows: DataFrame, width: int, centre: np.ndarray) -> tuple[int, list[int], list[list[int]]]:
    """Number, sums and sums of products of x - centre: exact integers. The driver gets width and
    width x width numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, n = np.zeros(width, object), np.zeros((width, width), object), 0
        for batch in batches:
            d = _matrix(batch.column(0), width) - centre
            n += len(d)
            first += d.sum(axis=0).astype(object)
            most = int(np.abs(d).max(initial=0))
            # Sums of whole numbers below 2^53 are exact in doubles, and those go faster.
            if most * most * max(len(d), 1) < 1 << 53:
                f = d.astype(np.float64)
                second += (f.T @ f).astype(np.int64).astype(object)
            else:
                o = d.astype(object)
                second += o.T @ o
        numbers = [n, *first.tolist(), *second.ravel().tolist()]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(numbers))), pa.array([str(v) for v in numbers])], names=["at", "v"])

    found = [0] * (1 + width + width * width)
    sums = rows.select("x").mapInArrow(run, "at bigint, v string").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    for row in sums.collect():
        found[row["at"]] = int(row["v"])
    products = [found[1 + width + i * width :][:width] for i in range(width)]
    return found[0], found[1 : 1 + width], products


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """key, component (from 1), n (distinct vectors), deviation (sum over dimensions of
    (n x - S)^2, S the sums), whitened (x - S/n on the component, over the root of its
    eigenvalue), explained (share of the trace), identity_error (largest entry of the covariance
    of `whitened` over the distinct vectors, less the identity)."""
    rows = vectors.select(F.col(key).alias("key"), whole(F.col(vector)).alias("x")).where("x is not null")
    rows = written(rows, "whitening-rows")
    fit = written(rows.select("x").distinct(), "whitening-fit")
    width = int(fit.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0])
    if fit.select(F.size("x")).where(F.size("x") != width).limit(1).count():
        # Vectors that differ in trailing zeros are one.
        full = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get("x", i), F.lit(OFFSET).cast("bigint")))
        rows = rows.withColumn("x", full)
        fit = written(rows.select("x").distinct(), "whitening-fit")
    kind = dict(rows.dtypes)["key"]
    schema = f"key {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    names = ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    if not width:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)

    near = np.full(width, OFFSET, np.int64)
    n, sums, _ = _sums(fit, width, near) if fit.limit(1).count() else (0, [0] * width, [])
    centre = near + np.array([s // n if n else 0 for s in sums], np.int64)
    n, sums, products = _sums(fit, width, centre)
    # Exact: n n times the covariance, and what is left of the mean.
    cells = [[n * products[i][j] - sums[i] * sums[j] for j in range(width)] for i in range(width)]
    covariance = np.array([[_long(Fraction(c, n * n)) for c in line] for line in cells], np.longdouble)
    values, turn = eigen(covariance)
    trace = covariance.trace()
    kept = int((values[:components] > ZERO * trace).sum()) if trace > 0 else 0
    if not kept:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    project = (turn[:, :kept] / np.sqrt(values[:kept])).astype(np.float64)
    rest = np.array([s / n for s in sums])
    shares = (values[:kept] / trace).astype(np.float64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((kept, kept))
        for batch in batches:
            y = (_matrix(batch.column(0), width) - centre - rest) @ project
            found += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(kept * kept)), pa.array(found.ravel())], names=["at", "v"])

    measured = np.zeros(kept * kept)
    for row in fit.mapInArrow(spread, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        measured[row["at"]] = row["v"] / n
    error = float(np.abs(measured.reshape(kept, kept) - np.eye(kept)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                d = _matrix(part.column(1), width) - centre
                whitened = (d - rest) @ project
                times = len(d)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(times), kept))),
                        pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), times)),
                        pa.array(np.full(times * kept, n)),
                        pa.array(_deviations(d, n, sums)).take(pa.array(np.repeat(np.arange(times), kept))),
                        pa.array(whitened.ravel()),
                        pa.array(np.tile(shares, times)),
                        pa.array(np.full(times * kept, error)),
                    ],
                    names=names,
                )

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def _long(value: Fraction) -> np.longdouble:
    """The nearest number in extended precision, but for its last bit."""
    high = float(value)
    return np.longdouble(high) + np.longdouble(float(value - Fraction(high)))


def _deviations(d: np.ndarray, n: int, sums: list[int]) -> np.ndarray | list[int | None]:
    """Sum of (n x - S)^2 of every row, where d = x - centre and sums those of d: exact."""
    most = n * int(np.abs(d).max(initial=0)) + max(map(abs, sums))
    if most * most * max(d.shape[1], 1) < 1 << 63:
        off = n * d - np.array(sums, np.int64)
        return (off * off).sum(axis=1)
    off = d.astype(object) * n - np.array(sums, object)
    return [v if v < 1 << 63 else None for v in (off * off).sum(axis=1)]
