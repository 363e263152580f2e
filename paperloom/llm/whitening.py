"""Embedding whitening.  Covariances come from variances alone (polarisation): the variance of a sum of two dimensions
less both variances is twice their covariance, and every variance is an exact sum of squared centred whole numbers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.blocks import map_batches, narrow, sum_rows

UNITS = 64  # steps of the fixed-point form to one
SHIFT = 1_000_000
COMPONENTS = 32
BLOCK_ROWS = 4096
_TOTALS = "i int, j int, total decimal(38,0)"
_LONG = 1 << 63


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a vector of finite numbers only, and those vectors in fixed point (rows x dimensions)."""
    keep = column.is_valid().to_numpy(zero_copy_only=False)
    lists = column.filter(pa.array(keep))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become not-a-number
    ends = np.concatenate([[0], np.cumsum(sizes)])
    good = sum_rows(~np.isfinite(values), ends) == 0
    keep[keep] = good
    sizes, values = sizes[good], values[np.repeat(good, np.diff(ends))]
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of different lengths have no covariance")
    values = np.floor(values * UNITS).reshape(len(sizes), sizes[0] if len(sizes) else 0)
    if len(values) and values.size and np.abs(values).max() >= _LONG - SHIFT:
        raise OverflowError("an entry does not fit a long in fixed point")
    return keep, values.astype(np.int64) + SHIFT


def _blocks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows with usable vectors, in blocks of bounded height, with the vectors."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            keep, x = usable(part.column(at))
            if len(x):
                yield part.filter(pa.array(keep)), x


def _whole(total: np.ndarray, highest: int, rows: int) -> np.ndarray:
    """``total`` summed over its first axis: in 64 bits where no sum can leave them, else in Python's whole numbers."""
    if highest * rows < _LONG:
        return total.sum(axis=0).astype(object)
    return total.astype(object).sum(axis=0)


def _squares(y: np.ndarray, highest: int) -> np.ndarray:
    """Squares in 64 bits where they fit, else in Python's whole numbers."""
    return (y if highest * highest < _LONG else y.astype(object)) ** 2


def _total_rows(i: np.ndarray, j: np.ndarray, totals: list[int]) -> pa.RecordBatch:
    from decimal import Context

    exact = Context(prec=38)
    return pa.record_batch(
        [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(map(exact.create_decimal, totals), pa.decimal128(38, 0))],
        ["i", "j", "total"],
    )


def _summed(rows: DataFrame) -> list:
    """Totals over all tasks; one row per dimension or pair of dimensions reaches the driver."""
    return rows.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()


@dataclass(frozen=True)
class Whitening:
    """A fit: ``n`` vectors, per-dimension sums, components as columns by falling eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray  # dimensions x components
    eigenvalues: np.ndarray
    explained: np.ndarray

    @property
    def present(self) -> np.ndarray:
        """Components with a variance above rounding; the others have no whitened direction."""
        floor = len(self.sums) * np.finfo(float).eps * max(self.eigenvalues.max(initial=0.0), 0.0)
        return self.eigenvalues > floor

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``x`` less the rounded-down means, and what is left of the means times n: both exact."""
        middle = np.array([s // self.n for s in self.sums], np.int64)
        return x - middle, np.array([s % self.n for s in self.sums], np.int64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Centred vectors along the components over the root of their eigenvalues; not-a-number where absent."""
        y, rest = self.centred(x)
        scale = np.full(len(self.eigenvalues), np.nan)
        scale[self.present] = 1 / np.sqrt(self.eigenvalues[self.present])
        return (y - rest / self.n) @ self.components * scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum of squared ``n * x - S`` of each row, exact."""
        y, rest = self.centred(x)
        highest = (int(np.abs(y).max(initial=0)) + 1) * self.n
        if highest * highest * len(self.sums) < _LONG:
            return ((self.n * y - rest) ** 2).sum(axis=1).tolist()
        return ((self.n * y.astype(object) - rest.astype(object)) ** 2).sum(axis=1).tolist()


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Exact covariance of all usable vectors in column ``v`` and its leading eigenvectors; None without vectors.

    The first pass sums each dimension, the second sums the squares of every centred dimension and of every sum of two
    centred dimensions, each task in whole numbers and with one row per pair for its whole partition.  Dimensions
    squared is all that the driver holds.  Centring subtracts the rounded-down mean; what that leaves is taken out
    again exactly.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for _, x in _blocks(batches, 0):
            own = _whole(x, int(np.abs(x).max(initial=0)), len(x))
            if sums is not None and len(sums) != len(own):
                raise ValueError("vectors of different lengths have no covariance")
            n, sums = n + len(x), own if sums is None else sums + own
        if sums is not None:
            i = np.arange(-1, len(sums))
            yield _total_rows(i, np.zeros_like(i), [n, *sums])
            yield _total_rows(i[1:], np.ones_like(i[1:]), [n] * len(sums))

    found = {(r["i"], r["j"]): int(r["total"]) for r in _summed(map_batches(vectors.select("v"), add, _TOTALS))}
    n = found.pop((-1, 0), 0)
    if not n:
        return None
    if any(count != n for (_, j), count in found.items() if j == 1):
        raise ValueError("vectors of different lengths have no covariance")
    width = sum(j for _, j in found)
    sums = [found[i, 0] for i in range(width)]
    middle = np.array([s // n for s in sums], np.int64)
    first, second = np.triu_indices(width)

    def square(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = None
        for _, x in _blocks(batches, 0):
            y = x - middle
            highest = 2 * int(np.abs(y).max(initial=0))
            parts = []
            for i in range(width):  # the dimension itself, then its sums with all later ones
                both = y[:, i:] + y[:, i : i + 1]
                both[:, 0] = y[:, i]
                parts.append(_whole(_squares(both, highest), highest * highest, len(y)))
            own = np.concatenate(parts) if parts else np.zeros(0, object)
            totals = own if totals is None else totals + own
        if totals is not None:
            yield _total_rows(first, second, totals.tolist())

    squares = {(r["i"], r["j"]): int(r["total"]) for r in _summed(map_batches(vectors.select("v"), square, _TOTALS))}
    rest = [s % n for s in sums]
    # n times the summed squares of exactly centred values, of dimensions and of sums of two
    spread = {
        (i, j): n * total - (rest[i] if i == j else rest[i] + rest[j]) ** 2 for (i, j), total in squares.items()
    }
    covariance = np.zeros((width, width))
    for i, j in spread:
        own = spread[i, j] if i == j else spread[i, j] - spread[i, i] - spread[j, j]
        covariance[i, j] = covariance[j, i] = own / (n * n * (1 if i == j else 2))
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    if width:
        axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    trace = float(np.trace(covariance))
    explained = np.maximum(values, 0.0) / trace if trace > 0 else np.zeros(len(values))
    return Whitening(n, sums, axes, values, explained)


def apply_whitening(vectors: DataFrame, fit: Whitening) -> DataFrame:
    """``id, deviation, whitened`` of every usable row (id, v).  Map-only."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Context

        exact = Context(prec=38)
        for part, x in _blocks(batches, 1):
            white = fit.whitened(x)
            ends = np.arange(len(x) + 1, dtype=np.int32) * white.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(white.ravel(), from_pandas=True))
            far = pa.array(map(exact.create_decimal, fit.deviations(x)), pa.decimal128(38, 0))
            yield pa.record_batch([part.column(0), far, lists], ["id", "deviation", "whitened"])

    kind = vectors.schema["id"].dataType.simpleString()
    return map_batches(vectors.select("id", "v"), project, f"id {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(vectors: DataFrame, fit: Whitening) -> float:
    """Largest absolute entry of the covariance of all whitened vectors less the identity, measured over the rows.

    Whitened vectors are centred by their making; each task sums their products, components squared reach the driver.
    """
    present = np.flatnonzero(fit.present)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(present), len(present)))
        for _, x in _blocks(batches, 0):
            white = fit.whitened(x)[:, present]
            total += white.T @ white
        i, j = np.indices(total.shape)
        yield pa.record_batch([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "total"])

    off = 0.0
    for r in _summed(map_batches(vectors.select("v"), multiply, "i int, j int, total double")):
        off = max(off, abs(r["total"] / fit.n - (r["i"] == r["j"])))
    return off


def whiten(
    rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, Whitening | None]:
    """``id_col, deviation, whitened`` (one entry per component) of every row with a vector, and the fit.

    Null vectors and vectors with null or non-finite entries are left out of fit and result.  Repeated rows count as
    often as they stand there; a row without an id is whitened like any other.  A component without variance has null
    entries.  An empty table gives no rows and no fit.  Vectors of different lengths and entries that do not fit a
    long in fixed point stop the job with an error.
    """
    vectors = narrow(rows, id=id_col, v=vector_col)
    fit = fit_whitening(vectors, components)
    if fit is None:
        empty = vectors.where(F.lit(False)).select("id", F.lit(0).cast("decimal(38,0)").alias("deviation"))
        return empty.withColumn("whitened", F.array().cast("array<double>")).withColumnRenamed("id", id_col), None
    return apply_whitening(vectors, fit).withColumnRenamed("id", id_col), fit
