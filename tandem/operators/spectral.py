"""Spectral clusters of symbols for many numbers of clusters at once.

With W the affinities (one on the diagonal) and D its row sums, the leading eigenvectors of D^-1/2 W D^-1/2 are found
by block iteration: a product is one join of the affinity edges with the block and one aggregation; of the block only
Gram matrices (width x width, whatever the number of symbols) reach the driver, where a Rayleigh-Ritz step turns them into
rotations that the tasks apply.  A block as wide as the universe is exact at once.  The coordinates of a symbol are its
entries in the first k vectors over the root of its row sum.

K-means runs for all k together from one table of points.  Seeds are farthest points (the first farthest from the mean,
the next farthest from all seeds, ties to the greater name), so equal input gives equal clusters.  Centres are k
vectors of k numbers for each k.  A k beyond the number of different points gives as many clusters as there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tandem.sources.shared import written

#: Columns of a block beyond the greatest k; the more, the faster it settles, and a universe of no more symbols than columns takes one product.
EXTRA = 48
#: Share of the largest squared length below which a direction of a block counts as none.
NOTHING = 1e-14
#: Residuals below this come from the differences themselves: out of Gram matrices they are no better than the root of the rounding.
CLOSE = 1e-6


def normalised(weights: DataFrame) -> DataFrame:
    """(a, b, m, root) both ways and with the diagonal, from a < b with ``weight``; root: that of the row sum of a."""
    both = weights.select("a", "b", "weight").unionByName(weights.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    names = both.select("a").distinct()
    whole = both.unionByName(names.select("a", F.col("a").alias("b"), F.lit(1.0).alias("weight")))
    roots = whole.groupBy("a").agg(F.sqrt(F.sum("weight")).alias("root"))
    return (whole.join(roots, "a").join(roots.select(F.col("a").alias("b"), F.col("root").alias("other")), "b")
            .select("a", "b", (F.col("weight") / F.col("root") / F.col("other")).alias("m"), "root"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=float).reshape(len(column), -1)


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (x, y) to the entries of X'Y and Y'Y of a task."""
    xy = yy = 0.0
    for batch in batches:
        if batch.num_rows:
            x, y = _matrix(batch.column(0)), _matrix(batch.column(1))
            xy, yy = xy + x.T @ y, yy + y.T @ y
    for kind, entries in enumerate((xy, yy)):
        if not np.isscalar(entries):
            i, j = np.indices(entries.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(entries.size, kind)), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(entries.ravel())], names=["kind", "i", "j", "s"])


def grams(block: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """X'Y and Y'Y of a block of rows (symbol, x, y)."""
    found = block.select("x", "y").mapInArrow(_products, "kind long, i long, j long, s double").groupBy("kind", "i", "j").agg(F.sum("s").alias("s")).collect()
    out = [np.zeros((1 + max(r.i for r in found), 1 + max(r.j for r in found))) for _ in range(2)]
    for r in found:
        out[r.kind][r.i, r.j] = r.s
    return out[0], out[1]


def residuals(block: DataFrame, value: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Lengths of the columns of Y turn - X turn diag(value), for a block of rows (symbol, x, y)."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                total = total + ((_matrix(batch.column(1)) @ turn - _matrix(batch.column(0)) @ turn * value) ** 2).sum(axis=0)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["j", "s"])
    found = block.select("x", "y").mapInArrow(rows, "j long, s double").groupBy("j").agg(F.sum("s").alias("s")).collect()
    return np.sqrt([r.s for r in sorted(found)])


def _turned(block: DataFrame, turn: np.ndarray) -> DataFrame:
    """Rows (symbol, x): y times ``turn``."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((_matrix(batch.column(1)) @ turn).tolist(), pa.list_(pa.float64()))], names=["symbol", "x"])
    return block.select("symbol", "y").mapInArrow(rows, "symbol string, x array<double>")


def _whitener(gram: np.ndarray) -> np.ndarray:
    length, axis = np.linalg.eigh(gram)
    keep = length > NOTHING * length[-1]
    return (axis[:, keep] / np.sqrt(length[keep]))[:, ::-1]


def orthonormal(block: DataFrame, name: str) -> DataFrame:
    """The block (symbol, y) as (symbol, x) with orthonormal columns, twice over since a Gram matrix squares the condition."""
    for _ in range(2):
        table = written(_turned(block, _whitener(grams(block.select("symbol", F.col("y").alias("x"), "y"))[1])), name)
        block = table.withColumnRenamed("x", "y")
    return table


def embedding(weights: DataFrame, width: int, rounds: int = 100, tolerance: float = 1e-8) -> DataFrame:
    """(symbol, v): coordinates of each symbol in the first ``width`` eigenvectors (fewer, if the matrix has fewer).

    Ends when every residual is below ``tolerance`` or after ``rounds`` products, with the best vectors of the block.
    """
    edges = written(normalised(weights), "edges")
    block = width + EXTRA
    start = F.array(*[F.xxhash64("a", F.lit(j)) / F.lit(2.0 ** 63) for j in range(block)])
    basis = orthonormal(edges.select("a").distinct().select(F.col("a").alias("symbol"), start.alias("y")), "basis")
    while True:
        n = len(basis.first().x)
        columns = basis.select(F.col("symbol").alias("b"), *[F.col("x")[j].alias(f"x{j}") for j in range(n)])
        product = edges.join(columns, "b").groupBy("a").agg(*[F.sum(F.col("m") * F.col(f"x{j}")).alias(f"y{j}") for j in range(n)])
        both = written(basis.join(product.select(F.col("a").alias("symbol"), F.array(*[f"y{j}" for j in range(n)]).alias("y")), "symbol"), "block")
        xy, yy = grams(both)
        value, turn = np.linalg.eigh((xy + xy.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        off = np.sqrt(np.maximum(0, np.einsum("ij,ik,kj->j", turn, yy, turn) - value ** 2))
        if off[:width].max() <= CLOSE:
            off = residuals(both, value, turn)
        rounds -= 1
        if off[:width].max() <= tolerance or rounds <= 0:
            break
        basis = orthonormal(both.select("symbol", "y"), "basis")
    vectors = _turned(both.select("symbol", F.col("x").alias("y")), turn[:, :width])
    roots = edges.where("a = b").select(F.col("a").alias("symbol"), "root")
    return vectors.join(roots, "symbol").select("symbol", F.transform("x", lambda x: x / F.col("root")).alias("v"))


def _square(v: Column, c: Column) -> Column:
    return F.aggregate(F.zip_with(v, c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _nearest(points: DataFrame, centres: dict[int, list[list[float]]]) -> DataFrame:
    """Points with the squared distance to the nearest centre of their k, and its number."""
    rows = [(k, [(i, c) for i, c in enumerate(cs)]) for k, cs in centres.items()]
    table = points.sparkSession.createDataFrame(rows, "asked_k int, centres array<struct<cluster:int,c:array<double>>>")
    best = F.array_min(F.transform("centres", lambda c: F.struct(_square(F.col("v"), c["c"]).alias("d"), c["cluster"].alias("cluster"))))
    return points.join(table, "asked_k").withColumn("best", best).select("asked_k", "symbol", "v", F.col("best.d").alias("d"), F.col("best.cluster").alias("cluster"))


def _means(rows: DataFrame) -> dict[tuple[int, int], list[float]]:
    """Of (asked_k, cluster, v): the mean of each cluster."""
    found = rows.select("asked_k", "cluster", F.posexplode("v").alias("i", "x")).groupBy("asked_k", "cluster", "i").agg(F.avg("x").alias("x"))
    return {(r.asked_k, r.cluster): r.v for r in found.groupBy("asked_k", "cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v")).collect()}


def k_means(points: DataFrame, rounds: int = 100) -> DataFrame:
    """(asked_k, symbol, cluster) of points (asked_k, symbol, v): for each k, k clusters by Lloyd's steps."""
    middle = {k: [v] for (k, _), v in _means(points.withColumn("cluster", F.lit(0))).items()}
    centres: dict[int, list[list[float]]] = {k: [] for k in middle}
    growing = set(middle)
    while growing:
        far = _nearest(points.where(F.col("asked_k").isin(*growing)), {k: centres[k] or middle[k] for k in growing})
        for r in far.groupBy("asked_k").agg(F.max(F.struct("d", "symbol", "v")).alias("m")).collect():
            if r.m.d > 0 or not centres[r.asked_k]:
                centres[r.asked_k].append(r.m.v)
            if r.m.d <= 0 or len(centres[r.asked_k]) >= r.asked_k:
                growing.discard(r.asked_k)
    for _ in range(rounds):
        new = _means(_nearest(points, centres)) if centres else {}
        after = {k: [new.get((k, i), c) for i, c in enumerate(cs)] for k, cs in centres.items()}
        same = all(np.allclose(centres[k], after[k], rtol=0, atol=1e-12) for k in centres)
        centres = after
        if same:
            break
    return _nearest(points, centres).select("asked_k", "symbol", "cluster") if centres else points.selectExpr("asked_k", "symbol", "0 AS cluster")


def spectral_clusters(weights: DataFrame, ks: Iterable[int]) -> DataFrame:
    """(asked_k, symbol, cluster) for each k, all from one embedding of the affinities (a < b, weight)."""
    ks = sorted(set(ks))
    if not weights.head(1):
        return weights.selectExpr("0 AS asked_k", "a AS symbol", "0 AS cluster").where("false")
    own = embedding(weights, ks[-1])
    points = own.select(F.explode(F.array(*[F.lit(k) for k in ks])).alias("asked_k"), "symbol", "v")
    return k_means(written(points.withColumn("v", F.slice("v", F.lit(1), F.col("asked_k"))), "points"))
