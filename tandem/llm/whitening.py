"""Whitening of embeddings by shifted CholeskyQR.

The rows, less their mean, are a tall matrix Y that stays in its partitions.  A pass sends the Gram matrix of the rows
as they stand to the driver (width x width numbers, whatever the number of rows); its Cholesky factor R_1 turns, by
triangular solves inside the tasks, Y into Q_1 = Y R_1^-1, and so on: the first Gram matrix is shifted by a multiple of
the rounding error, so that the factor exists however badly the columns are conditioned, and the passes go on until
the columns are orthonormal.  Then Y = Q R with R = R_k .. R_1; the right singular vectors of R are the components, and
its squared singular values over n the variances.  The normal equations are never squared into the result: a variance
10^-20 times the largest still comes out right.

Each component c of a vector becomes the integer floor(1024 * c) + 100000.  Sums are exact integers, and the centred
row is (n * x - S) / n, so that the offset costs no digits.

Defined cases: null vectors and vectors with a null or non-finite component take no part; a vector shorter than the
longest is filled up with 0.0; rows may have a null id or repeat one; columns that depend on others, and constant ones,
give no component (there are as many as the rank, at most ``components``), so a single vector, equal vectors or an
empty table give an empty result.  Numbers that would not fit into 64 bits exactly raise an error instead of a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tandem.llm.storage import ready, stored

SCALE, OFFSET = 1024, 100_000
#: Passes at most, and how far from orthonormal the last one may leave the columns.
PASSES = 6
ORTHONORMAL = 1e-13
LARGEST = 2.0 ** 62


def fits(column: str):
    return F.col(column).isNotNull() & F.forall(column, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))


def _shifted_integers(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            x = np.zeros((len(batch), width))
            flat, at = vectors.flatten().to_numpy(zero_copy_only=False), vectors.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(at)), at)
            x[row, np.arange(len(row)) - np.repeat(np.cumsum(at) - at, at)] = flat
            scaled = np.floor(x * SCALE)
            if len(scaled) and np.abs(scaled).max() > 2.0 ** 52:
                raise ArithmeticError("a component is too large for an exact integer")
            whole = scaled.astype(np.int64) + OFFSET
            yield pa.RecordBatch.from_arrays([ids, pa.array([r.tobytes() for r in whole], pa.binary())], names=["vec_id", "x"])
    return rows


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, width)


@dataclass(frozen=True)
class Centre:
    """Number of vectors and exact sums of their integers."""

    n: int
    sums: np.ndarray

    def exact(self, x: np.ndarray) -> np.ndarray:
        """n * x - S as integers."""
        if len(x) and float(self.n) * float(np.abs(x).max()) > LARGEST:
            raise ArithmeticError("n * x does not fit into 64 bits")
        return self.n * x - self.sums

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.exact(x) / float(self.n)


def solve(y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Q with Q r = y, column by column (r is upper triangular)."""
    q = np.empty_like(y)
    for j in range(r.shape[0]):
        q[:, j] = (y[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def orthogonalised(y: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    for r in factors:
        y = solve(y, r)
    return y


def _summed(table: DataFrame, width: int, size: int, work: Callable[[np.ndarray], np.ndarray], kind=np.float64) -> np.ndarray:
    """Sum over all rows of ``work(block of rows)``: ``size`` numbers a partition, added up by position."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros(size, kind), False
        for batch in batches:
            if len(batch):
                total += work(_matrix(batch.column(0), width))
                any_row = True
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["at", "s"])
    out = np.zeros(size, kind)
    name = "long" if kind is np.int64 else "double"
    for r in table.select("x").mapInArrow(rows, f"at long, s {name}").groupBy("at").agg(F.sum("s").alias("s")).collect():  # size rows
        out[r["at"]] = r["s"]
    return out


def centre(table: DataFrame, width: int) -> Centre:
    """Number of rows and exact sums (64-bit sums; Spark refuses to overflow)."""
    def sums(x: np.ndarray) -> np.ndarray:
        if float(len(x)) * float(np.abs(x).max(initial=0)) > LARGEST:
            raise ArithmeticError("sums do not fit into 64 bits")
        return np.append(x.sum(axis=0), len(x))
    found = _summed(table, width, width + 1, sums, np.int64)
    return Centre(int(found[-1]), found[:-1])


def gram(table: DataFrame, width: int, middle: Centre, factors: list[np.ndarray]) -> np.ndarray:
    upper = np.triu_indices(width)

    def products(x: np.ndarray) -> np.ndarray:
        q = orthogonalised(middle.rows(x), factors)
        return (q.T @ q)[upper]
    g = np.zeros((width, width))
    g[upper] = _summed(table, width, len(upper[0]), products)
    return g + np.triu(g, 1).T


def cholesky(g: np.ndarray, shift: float) -> np.ndarray:
    """Upper factor of g + shift; the shift grows until there is one."""
    eye = np.eye(len(g))
    while True:
        try:
            return np.linalg.cholesky(g + shift * eye).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, np.finfo(float).eps * np.trace(g), np.finfo(float).tiny)


@dataclass(frozen=True)
class Whitening:
    """Unit components in columns by falling variance, their variances, and the trace of the covariance."""

    axes: np.ndarray
    variances: np.ndarray
    trace: float


def fit(table: DataFrame, width: int, middle: Centre, components: int) -> Whitening:
    unit = np.finfo(float).eps / 2
    factors: list[np.ndarray] = []
    r = np.eye(width)
    g = gram(table, width, middle, factors)
    trace = float(np.trace(g))
    if trace <= 0:
        return Whitening(np.zeros((width, 0)), np.zeros(0), 0.0)
    for step in range(PASSES):
        if step and np.abs(g - np.eye(width)).max() <= ORTHONORMAL * max(1.0, np.sqrt(middle.n)):
            break
        shift = 11 * (middle.n * width + width * (width + 1)) * unit * trace if step == 0 else 0.0
        factor = cholesky(g, min(shift, trace / width * 1e-3))
        factors.append(factor)
        r = factor @ r
        g = gram(table, width, middle, factors)
    # what the last pass left: its Gram matrix is the identity, but for directions that no row has (0 there)
    left, turn = np.linalg.eigh(g)
    r = np.sqrt(np.clip(left, 0, None))[:, None] * (turn.T @ r)
    _, singular, axes = np.linalg.svd(r)
    keep = min(components, int((singular > singular[0] * width * 20 * unit).sum()))
    axes = axes[:keep].T
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None, :], 0) < 0, -1.0, 1.0)
    return Whitening(axes, singular[:keep] ** 2 / middle.n, float((singular ** 2).sum() / middle.n))


def identity_error(table: DataFrame, width: int, middle: Centre, found: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity."""
    k = found.axes.shape[1]
    turn = found.axes / np.sqrt(found.variances)
    mean = _summed(table, width, k, lambda x: (middle.rows(x) @ turn).sum(axis=0)) / middle.n

    def products(x: np.ndarray) -> np.ndarray:
        w = middle.rows(x) @ turn - mean
        return (w.T @ w).ravel()
    cov = _summed(table, width, k * k, products).reshape(k, k) / middle.n
    return float(np.abs(cov - np.eye(k)).max())


def _apply(width: int, middle: Centre, found: Whitening, error: float):
    k = found.axes.shape[1]
    turn = found.axes / np.sqrt(found.variances)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact = middle.exact(_matrix(batch.column(1), width))
            if len(exact) and ((exact.astype(np.float64) ** 2).sum(axis=1).max() > 2.0 ** 63 * (1 - 1e-9)):
                raise ArithmeticError("the squared deviation does not fit into 64 bits")
            w = (exact / float(middle.n)) @ turn
            n = len(exact)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                 pa.array(np.full(n * k, middle.n)), pa.array(np.repeat((exact * exact).sum(axis=1), k)), pa.array(w.ravel()),
                 pa.array(np.tile(found.variances / found.trace, n)), pa.array(np.full(n * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and component: exact squared deviation (times n squared), whitened coordinate, share of the variance."""
    spark = vectors.sparkSession
    ready(spark)
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(fits("v"))
    width = own.agg(F.max(F.size("v"))).first()[0] or 0
    if not width:
        return spark.createDataFrame([], RESULT)
    table = stored(own.mapInArrow(_shifted_integers(width), "vec_id long, x binary"), "vectors").df
    middle = centre(table, width)
    found = fit(table, width, middle, components)
    if not len(found.variances):
        return spark.createDataFrame([], RESULT)
    error = identity_error(table, width, middle, found)
    return table.mapInArrow(_apply(width, middle, found, error), RESULT)


def op11(embeddings: DataFrame) -> DataFrame:
    return whiten(embeddings)
