"""Hard negatives by segment summaries.

Each vector is cut into segments, at several levels of fineness; of each segment its mean and its deviation (length of
what is left without the mean) are stored beside the vector.  The product of two segments is len * mean * mean' plus
something between minus and plus the product of the deviations, so the sums over segments bound a score from both
sides.  Inside a task, candidates are first bounded by the coarsest level; the rows and columns of the score matrix in
which some pair may still count are bounded again by the finer levels, and only what is left is multiplied exactly.  A
pair may count where its bounds reach into an interval of wanted scores, above the k-th best found there so far.

First each anchor's positives are found (the best of its own label, no interval), then its negatives: for each positive
the best of other labels whose score lies between two shares of the positive's.

Vectors are stored once, range-partitioned by label and a hash, so that a part holds few labels and one large label is
many parts.  Anchors are dealt to blocks; a tile of (block, part) is a task's work, of bounded size, and carries its own
rows: nothing passes through the driver, and a lost task is done again from the stored table.  Anchors meet only parts
that hold their label (positives) or another one (negatives).  Each tile returns at most k rows per interval.

Scores are integers below 2^53 and therefore exact as doubles; larger vectors raise an error.  Bounds are widened by
the rounding error and equal scores are never pruned.

Defined cases: rows without label, id or vector, or with a null or non-finite component, take no part; a shorter vector
is filled up with zeros; rows that repeat an id are candidates of their own, none of them a partner of an anchor with
that id; of several anchor rows with one id the one of the smallest label, then vector, is taken; an anchor without
another row of its label has no rows, and so has a positive with a negative score; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tandem.llm.storage import parts_for, ready, stored
from tandem.llm.whitening import fits

SCALE = 256
#: Segments at each level, rows of a part, anchors of a block, candidates at once.
LEVELS = (4, 16)
PER_PART = 16_384
BLOCK = 2048
AT_ONCE = 2048
EXACT = 2.0 ** 53


@dataclass(frozen=True)
class Shares:
    """Negatives score from ``low`` to ``high`` hundredths of their positive's score."""

    low: int = 30
    high: int = 90


def edges(width: int, segments: int) -> np.ndarray:
    return np.linspace(0, width, min(segments, width) + 1).astype(np.int64)


def summaries(v: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean times the root of the length, and deviation, of each segment: products of the former add up to the means' part."""
    at = edges(v.shape[1], segments)
    length = np.diff(at)
    mean = np.add.reduceat(v, at[:-1], axis=1) / length
    rest = v - np.repeat(mean, length, axis=1)
    return mean * np.sqrt(length), np.sqrt(np.add.reduceat(rest * rest, at[:-1], axis=1))


def _prepare(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            x = np.zeros((len(batch), width))
            flat, at = vectors.flatten().to_numpy(zero_copy_only=False), vectors.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(at)), at)
            x[row, np.arange(len(row)) - np.repeat(np.cumsum(at) - at, at)] = flat
            v = np.floor(x * SCALE)
            if len(v) and (np.abs(v).max() ** 2 * width >= EXACT or np.abs(v).max() >= 2 ** 31):
                raise ArithmeticError("a vector is too long for exact integer scores")
            told = np.concatenate([part for s in LEVELS for part in summaries(v, s)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r.tobytes() for r in v.astype(np.int32)], pa.binary()), pa.array([r.tobytes() for r in told], pa.binary())],
                names=["vec_id", "label", "v", "told"])
    return rows


def prepared(vectors: DataFrame, label: Column, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, label, v, told, part): integers and summaries, range-partitioned by label."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    own = own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()).where(fits("x"))
    size = own.agg(F.max(F.size("x")).alias("width"), F.count(F.lit(1)).alias("n")).first()
    width = max(1, size.width or 0)
    rows = own.mapInArrow(_prepare(width), "vec_id long, label long, v binary, told binary")
    dealt = rows.repartitionByRange(parts_for(size.n, PER_PART, 1), "label", F.xxhash64("vec_id", "v"))
    return stored(dealt.withColumn("part", F.spark_partition_id()), "negatives").df, width


@dataclass
class Rows:
    """Vectors of one side of a tile."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    told: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(table: pa.Table, width: int) -> Rows:
        n = table.num_rows
        v = np.frombuffer(b"".join(table.column("v").to_pylist()), np.int32).reshape(n, width).astype(np.float64)
        told = np.frombuffer(b"".join(table.column("told").to_pylist()), np.float64).reshape(n, -1)
        levels, at = [], 0
        for s in LEVELS:
            k = len(edges(width, s)) - 1
            levels.append((told[:, at:at + k], told[:, at + k:at + 2 * k]))
            at += 2 * k
        return Rows(table.column("vec_id").to_numpy(), table.column("label").to_numpy(), v, levels)

    def take(self, at) -> Rows:
        return Rows(self.ids[at], self.labels[at], self.v[at], [(m[at], d[at]) for m, d in self.told])


class Best:
    """The k best candidates of each anchor in each of its intervals [low, high] (high < low: none), ties to the smaller id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.score = np.full((*low.shape, k), -np.inf)
        self.id = np.full((*low.shape, k), np.iinfo(np.int64).max)

    def least(self) -> np.ndarray:
        """What a score has to reach to count in some interval of the anchor."""
        return np.where(self.high >= self.low, np.maximum(self.low, self.score[:, :, -1]), np.inf).min(axis=1)

    def most(self) -> np.ndarray:
        return np.where(self.high >= self.low, self.high, -np.inf).max(axis=1)

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        begin = np.searchsorted(row, np.arange(len(self.low) + 1))
        touched = np.flatnonzero(np.diff(begin))
        for j in range(self.low.shape[1]):
            above = np.bincount(row[score > self.high[row, j]], minlength=len(self.low))
            at = (begin[:-1] + above)[touched, None] + np.arange(self.k)
            fine = at < begin[1:][touched, None]
            at = np.where(fine, at, 0)
            fine &= score[at] >= self.low[touched, j][:, None]
            s = np.concatenate([self.score[touched, j], np.where(fine, score[at], -np.inf)], axis=1)
            i = np.concatenate([self.id[touched, j], np.where(fine, ids[at], np.iinfo(np.int64).max)], axis=1)
            top = np.lexsort((i, -s), axis=1)[:, :self.k]
            self.score[touched, j] = np.take_along_axis(s, top, 1)
            self.id[touched, j] = np.take_along_axis(i, top, 1)


def search(anchors: Rows, candidates: Rows, best: Best, same_label: bool) -> None:
    """Puts every pair that counts into ``best``: bounds from coarse to fine, then exact scores."""
    for lo in range(0, len(candidates.ids), AT_ONCE):
        some = candidates.take(slice(lo, lo + AT_ONCE))
        need = (anchors.labels[:, None] == some.labels) == same_label
        need &= anchors.ids[:, None] != some.ids
        a, c = np.arange(len(anchors.ids)), np.arange(len(some.ids))
        for level in range(len(LEVELS)):
            keep_a, keep_c = need.any(axis=1), need.any(axis=0)
            a, c, need = a[keep_a], c[keep_c], need[np.ix_(keep_a, keep_c)]
            if not need.size:
                break
            (m, d), (mc, dc) = (x[a] for x in anchors.told[level]), (x[c] for x in some.told[level])
            middle, reach = m @ mc.T, d @ dc.T
            slack = 1.0 + 1e-9 * (np.abs(middle) + reach)
            need &= (middle + reach + slack >= best.least()[a][:, None]) & (middle - reach - slack <= best.most()[a][:, None])
        if need.any():
            row, col = np.nonzero(need)
            score = (anchors.v[a] @ some.v[c].T)[row, col]  # integers below 2^53: exact
            good = (score >= best.least()[a[row]]) & (score <= best.most()[a[row]])
            best.add(a[row[good]], score[good], some.ids[c[col[good]]])


def _tile(width: int, k: int, same_label: bool):
    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        n, m = left.num_rows, right.num_rows
        if n and m:
            low, high = (np.array(left.column(c).to_pylist(), dtype=np.float64) for c in ("low", "high"))
            anchors = Rows.of(left, width)
            best = Best(low, high, k)
            search(anchors, Rows.of(right, width), best, same_label)
            i, j, place = np.nonzero(best.score > -np.inf)
            out = [anchors.ids[i], j.astype(np.int32), best.id[i, j, place], best.score[i, j, place].astype(np.int64)]
        else:
            out = [np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)]
        return pa.table(dict(zip(["anchor_id", "interval", "vec_id", "score"], map(pa.array, out))))
    return rows


def best_partners(anchors: DataFrame, table: DataFrame, tiles: DataFrame, width: int, k: int, same_label: bool) -> DataFrame:
    """(anchor_id, interval, vec_id, score, rank): k best partners in each interval, over the tiles (block, part) that matter.

    ``anchors`` carries ``block`` and arrays ``low`` and ``high``; the smallest and the largest double stand for no limit.
    """
    left = anchors.join(tiles, "block")
    own = tiles.select(F.col("block").alias("c_block"), F.col("part").alias("c_part"))
    right = table.select(F.col("part").alias("c_part"), *[F.col(c).alias(c) for c in ("vec_id", "label", "v", "told")]).join(own, "c_part")
    found = (left.groupBy("block", "part").cogroup(right.groupBy("c_block", "c_part"))
             .applyInArrow(_tile(width, k, same_label), "anchor_id long, interval int, vec_id long, score long"))
    place = F.row_number().over(Window.partitionBy("anchor_id", "interval").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, shares: Shares = Shares(), id_col: str = "vec_id",
                   label: Column | str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors whose id is divisible by ``every``."""
    ready(vectors.sparkSession)
    label = F.col(label) if isinstance(label, str) else label
    table, width = prepared(vectors, label, id_col, vector_col)
    own = table.where(F.col("vec_id") % every == 0)
    blocks = parts_for(own.count(), BLOCK, 1)
    anchors = stored(own.groupBy("vec_id").agg(F.min(F.struct("label", "v", "told")).alias("a")).select("vec_id", "a.*")
                     .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")), "anchors").df
    parts = table.groupBy("part", "label").count()
    held = stored(parts.groupBy("part").agg(F.min("label").alias("from"), F.max("label").alias("to")).join(parts, "part"), "parts").df
    wanted = anchors.select("block", "label").distinct()
    with_label = wanted.join(held, "label").select("block", "part").distinct()
    limit = 1.7976931348623157e308
    free = anchors.withColumns({"low": F.array(F.lit(-limit)), "high": F.array(F.lit(limit))})
    pairs = stored(best_partners(free, table, with_label, width, positives, True)
                   .select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place")), "positives").df
    # integer ends of the intervals: low * p <= 100 * s <= high * p
    p = F.col("positive_score")
    ends = pairs.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct(
        "place", F.ceil(p * shares.low / 100.0).cast("double").alias("low"), F.floor(p * shares.high / 100.0).cast("double").alias("high")))).alias("e"))
    empty = F.struct(F.lit(0).alias("place"), F.lit(limit).alias("low"), F.lit(-limit).alias("high"))
    full = F.concat("e", F.array_repeat(empty, F.lit(positives) - F.size("e")))
    bounded = (anchors.join(ends.withColumn("e", full), F.col("vec_id") == F.col("anchor_id"))
               .select(*anchors.columns, F.col("e.low").alias("low"), F.col("e.high").alias("high")))
    # a block skips a part only where all of the part and all of the block have one and the same label
    span = wanted.groupBy("block").agg(F.min("label").alias("b_from"), F.max("label").alias("b_to"))
    every_part = held.select("part", "from", "to").distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    with_other = (every_part.join(span, "block").where(~((F.col("from") == F.col("to")) & (F.col("b_from") == F.col("from")) & (F.col("b_to") == F.col("from"))))
                  .select("block", "part"))
    found = best_partners(bounded, table, with_other, width, negatives, False)
    return (found.join(pairs.withColumn("interval", F.col("place") - 1), ["anchor_id", "interval"])
            .where((F.col("score") * 100 >= p * shares.low) & (F.col("score") * 100 <= p * shares.high))
            .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))


def op12(embeddings: DataFrame) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(embeddings, label=label)


OP12_SQL = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10
"""
