"""Exact top-k inner products: vectors by descending length, SVD-rotated partial sums, Cauchy-Schwarz residual bounds.

Components become floor(1024 * x); scores are exact integers.  All vectors are rotated by the right singular vectors
of the whole table (from its Gram matrix, which is of fixed size), so that the first coordinates carry most of a
product.  A query starts with the k-th best of its products with the longest vectors of the table.  A task then takes
candidates in the order of their length: when length times length cannot reach the query's k-th best any more, the
query is done; otherwise the product over the first coordinates plus the product of the residual lengths bounds the
score, and only candidates whose bound reaches the k-th best are multiplied exactly.  Bounds are widened by the
rounding error of doubles, and equal scores are never pruned, so the result is exact, ties to the smaller id.

Queries come in blocks of about ``BLOCK`` vectors; each block is broadcast and meets all candidates, which are
range-partitioned by length and id (one common vector therefore spreads).  Every task returns at most k rows a query.

Defined cases: null vectors, null ids and vectors with a null or non-finite component take no part; vectors of other
lengths are filled up with zeros; rows that repeat an id are candidates of their own, and none of them is a partner of
a query with that id; queries get fewer than k rows where fewer candidates exist; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tandem.llm.storage import parts_for, ready, stored

#: Queries of a block, longest vectors that give the first threshold, candidates at once and of a partition.
BLOCK = 2048
LONGEST = 512
AT_ONCE = 1024
PER_PART = 16_384
PAIRS = 1 << 18


def _integers(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            x = np.zeros((len(batch), width))
            flat, at = vectors.flatten().to_numpy(zero_copy_only=False), vectors.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(at)), at)
            x[row, np.arange(len(row)) - np.repeat(np.cumsum(at) - at, at)] = flat
            v = np.floor(x * 1024).astype(np.int64)
            length = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([ids, pa.array(length), pa.array([r.tobytes() for r in v], pa.binary())], names=["vec_id", "length", "v"])
    return rows


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, length, v) of all vectors that take part, and the number of components."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    fit = own.where("vec_id is not null and x is not null").where(
        F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))))
    width = fit.agg(F.max(F.size("x"))).first()[0] or 0
    return fit.mapInArrow(_integers(max(1, width)), "vec_id long, length double, v binary"), max(1, width)


def _matrix(column, width: int) -> np.ndarray:
    raw = column.to_pylist() if hasattr(column, "to_pylist") else list(column)
    return np.frombuffer(b"".join(raw), np.int64).reshape(-1, width)


def _gram(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            v = _matrix(batch.column(0), width).astype(np.float64)
            total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["at", "x"])
    return rows


def rotation(vectors: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """Right singular vectors in falling order, and how many of them hold nine tenths of the squared length (at least one)."""
    rows = vectors.select("v").mapInArrow(_gram(width), "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()  # width^2 rows
    gram = np.zeros(width * width)
    for r in rows:
        gram[r["at"]] = r["x"]
    values, axes = np.linalg.eigh(gram.reshape(width, width))
    values, axes = np.clip(values[::-1], 0, None), axes[:, ::-1]
    share = np.cumsum(values) / max(values.sum(), 1e-300)
    return np.ascontiguousarray(axes), int(min(width, np.searchsorted(share, 0.9) + 1))


@dataclass
class Queries:
    """A block of queries with the first threshold of each."""

    ids: np.ndarray
    v: np.ndarray
    axes: np.ndarray
    head: int
    k: int
    least: np.ndarray

    def __post_init__(self) -> None:
        turned = self.v.astype(np.float64) @ self.axes
        self.first = np.ascontiguousarray(turned[:, :self.head])
        self.rest = np.sqrt((turned[:, self.head:] ** 2).sum(axis=1))
        self.length = np.sqrt((self.v.astype(np.float64) ** 2).sum(axis=1))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def first_thresholds(ids: np.ndarray, v: np.ndarray, longest_ids: np.ndarray, longest: np.ndarray, k: int) -> np.ndarray:
    """The k-th best product of each query with the longest vectors (least possible where there are fewer)."""
    out = np.full(len(ids), np.iinfo(np.int64).min)
    for i in range(len(ids)):
        score = (longest @ v[i])[longest_ids != ids[i]]
        if len(score) >= k:
            out[i] = np.partition(score, -k)[-k]
    return out


def _search(shared, width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = shared.value
        least = q.least.astype(np.float64)
        kept = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in q.ids]
        for batch in batches:
            all_ids, all_v, all_len = batch.column(0).to_numpy(), _matrix(batch.column(2), width), batch.column(1).to_numpy()
            for lo in range(0, len(all_ids), AT_ONCE):
                ids, v, length = all_ids[lo:lo + AT_ONCE], all_v[lo:lo + AT_ONCE], all_len[lo:lo + AT_ONCE]
                slack = 1.0 + 1e-9 * q.length * length[0]
                live = np.flatnonzero(q.length * length[0] + slack >= least)  # the longest of what is left in this order
                if not len(live):
                    break
                turned = v.astype(np.float64) @ q.axes
                rest = np.sqrt((turned[:, q.head:] ** 2).sum(axis=1))
                bound = q.first[live] @ turned[:, :q.head].T + q.rest[live, None] * rest[None, :] + slack[live, None]
                row, col = np.nonzero((bound >= least[live, None]) & (ids[None, :] != q.ids[live, None]))
                score = np.concatenate([np.einsum("ij,ij->i", q.v[live[row[p:p + PAIRS]]], v[col[p:p + PAIRS]]) for p in range(0, len(row), PAIRS)]
                                       or [np.empty(0, np.int64)])
                edges = np.searchsorted(row, np.arange(len(live) + 1))
                for j in np.flatnonzero(np.diff(edges)):
                    i = live[j]
                    s = np.concatenate([kept[i][0], score[edges[j]:edges[j + 1]]])
                    c = np.concatenate([kept[i][1], ids[col[edges[j]:edges[j + 1]]]])
                    top = best(s, c, q.k)
                    kept[i] = s[top], c[top]
                    if len(top) == q.k:
                        least[i] = max(least[i], float(s[top[-1]]))
        n = [len(s) for s, _ in kept]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(q.ids, n)), pa.array(np.concatenate([c for _, c in kept]) if kept else np.empty(0, np.int64)),
             pa.array(np.concatenate([s for s, _ in kept]) if kept else np.empty(0, np.int64))], names=["query_id", "vec_id", "score"])
    return rows


def top_products(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best partners of every vector whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    ready(spark)
    found, width = integer_vectors(vectors, id_col, vector_col)
    table = stored(found, "vectors").df
    axes, head = rotation(table, width)
    longest = table.orderBy(F.desc("length"), "vec_id").limit(LONGEST).toPandas()
    n = table.count()
    queries = table.where(F.col("vec_id") % every == 0)
    blocks = parts_for(queries.count(), BLOCK, 1)
    falling = table.repartitionByRange(parts_for(n, PER_PART, 1), F.desc("length"), "vec_id").sortWithinPartitions(F.desc("length"), "vec_id")
    parts = []
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).dropDuplicates(["vec_id"]).toPandas()  # about BLOCK rows
        if not len(own):
            continue
        ids, v = own["vec_id"].to_numpy(), _matrix(list(own["v"]), width)
        least = first_thresholds(ids, v, longest["vec_id"].to_numpy(), _matrix(list(longest["v"]), width), k)
        shared = spark.sparkContext.broadcast(Queries(ids, v, axes, head, k, least))
        parts.append(falling.mapInArrow(_search(shared, width), "query_id long, vec_id long, score long"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionAll(more)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7(embeddings: DataFrame) -> DataFrame:
    return top_products(embeddings)


OP7_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
