"""Ordered computations that never gather one key's whole history in one task.

A window partitioned by symbol alone puts the hottest symbol (which may hold a
third of all rows) into a single task.  Everything here splits a key's rows
into slices first: small per-slice summaries are combined per key and joined
back, and frames that reach over a slice border get copies of the few border
rows they need.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK_ROWS = 50_000


def _before(keys: Sequence[str], slice_col: str):
    return Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_col: str,
                out: str = "rn") -> DataFrame:
    """0-based row number per key; ``slice_col`` must not decrease along ``order``."""
    offsets = (df.groupBy(*keys, slice_col).agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(_before(keys, slice_col)), F.lit(0)))
               .drop("_n"))
    w = Window.partitionBy(*keys, slice_col).orderBy(*order)
    return (df.join(offsets, [*keys, slice_col])
            .withColumn(out, F.row_number().over(w) - F.lit(1) + F.col("_off")).drop("_off"))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_col: str,
                value: str, out: str) -> DataFrame:
    """Cumulative sum per key (exact for integer values)."""
    offsets = (df.groupBy(*keys, slice_col).agg(F.sum(value).alias("_n"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(_before(keys, slice_col)), F.lit(0)))
               .drop("_n"))
    w = (Window.partitionBy(*keys, slice_col).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, 0))
    return (df.join(offsets, [*keys, slice_col])
            .withColumn(out, F.sum(value).over(w) + F.col("_off")).drop("_off"))


def running_extremes(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_col: str,
                     outs: dict[str, tuple[str, str]]) -> DataFrame:
    """Running max/min per key. ``outs``: output -> (value column, "max" | "min")."""
    fn = {"max": (F.max, F.greatest), "min": (F.min, F.least)}
    summary = df.groupBy(*keys, slice_col).agg(
        *[fn[kind][0](value).alias(f"_{out}") for out, (value, kind) in outs.items()])
    for out, (_, kind) in outs.items():
        summary = summary.withColumn(f"_c_{out}", fn[kind][0](f"_{out}").over(_before(keys, slice_col)))
    summary = summary.select(*keys, slice_col, *[f"_c_{out}" for out in outs])
    w = (Window.partitionBy(*keys, slice_col).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, 0))
    res = df.join(summary, [*keys, slice_col])
    for out, (value, kind) in outs.items():
        agg, pick = fn[kind]
        res = res.withColumn(out, pick(agg(value).over(w), F.col(f"_c_{out}"))).drop(f"_c_{out}")
    return res


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_col: str,
                  value: str, out: str) -> DataFrame:
    """Last non-null ``value`` at or before each row, per key."""
    order_key = F.struct(*order)
    last = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), order_key)).alias("_v")
    summary = (df.groupBy(*keys, slice_col).agg(last)
               .withColumn("_carry", F.last("_v", ignorenulls=True).over(_before(keys, slice_col)))
               .drop("_v"))
    w = (Window.partitionBy(*keys, slice_col).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, 0))
    return (df.join(summary, [*keys, slice_col])
            .withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(w), F.col("_carry")))
            .drop("_carry"))


def chunked(df: DataFrame, keys: Sequence[str], position: str | Column, back: int, ahead: int,
            build: Callable[[DataFrame, "Window"], DataFrame], size: int | None = None,
            order: Sequence[str] = ("_pos",)) -> DataFrame:
    """Apply window expressions whose frames reach ``back``/``ahead`` of a row.

    ``position`` is the row number (row frames) or epoch time (range frames).
    Rows are cut into chunks of ``size`` positions; each chunk also receives
    copies of the border rows its frames need, which are dropped afterwards.
    """
    size = max(size or CHUNK_ROWS, back + ahead, 1)
    pos = F.col(position) if isinstance(position, str) else position
    at = F.col("_pos") % F.lit(size)
    own = F.col("_own")
    homes = F.array_compact(F.array(
        own,
        F.when(at >= size - back, own + 1),
        F.when(at < ahead, own - 1)))
    spread = (df.withColumn("_pos", pos).withColumn("_own", F.floor(F.col("_pos") / F.lit(size)))
              .withColumn("_chunk", F.explode(homes)))
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return build(spread, w).where("_own = _chunk").drop("_pos", "_own", "_chunk")


def range_totals(df: DataFrame, keys: Sequence[str], position: str, reach: int, values: dict[str, Column],
                 finish: Callable[[dict[str, Column]], dict[str, Column]], size: int | None = None,
                 offsets: dict[str, Column] | None = None) -> DataFrame:
    """Sums over rows whose ``position`` lies within ``reach`` before the current one, peers included.

    A sliding range frame is recomputed for every row.  Here both ends are
    growing frames, which advance once per row, and their difference is the
    window; chunks of positions keep the tasks small.
    """
    def build(d, w):
        whole = w.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        if offsets:
            d = d.withColumns({n: F.first(c, ignorenulls=True).over(whole) for n, c in offsets.items()})
        now, gone = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(Window.unboundedPreceding, -reach - 1)
        total = lambda c, frame: F.coalesce(F.sum(c).over(frame), F.lit(0))
        d = d.withColumns({f"_r_{n}": total(c, now) - total(c, gone) for n, c in values.items()})
        d = d.withColumns(finish({n: F.col(f"_r_{n}") for n in values}))
        return d.drop(*[f"_r_{n}" for n in values], *(offsets or {}))

    return chunked(df, keys, position, reach, 0, build, size=size or reach)


def ema_terms(df: DataFrame, keys: Sequence[str], value: Column, weight: float, seed_rn: int,
              out: str, seed: Column | None = None, rn: str = "rn") -> DataFrame:
    """Exponential average e[t] = w*x[t] + (1-w)*e[t-1] as plain window sums.

    The row ``seed_rn`` starts the recursion with ``seed`` (default: its own
    value).  A block of B rows is summed with weights relative to its first row;
    what earlier blocks contribute decays by (1-w)**B, and B is chosen so that
    four blocks back the contribution is below double precision.
    """
    decay = 1.0 - weight
    block = max(1, int(30.0 / -math.log(decay))) if 0 < decay < 1 else 1
    first = seed if seed is not None else value
    k = F.col("_k")
    base = (df.withColumn("_t", F.col(rn) - F.lit(seed_rn))
            .withColumn("_b", F.when(F.col("_t") >= 0, F.floor(F.col("_t") / F.lit(block))))
            .withColumn("_k", F.when(F.col("_t") >= 0, F.col("_t") % F.lit(block)))
            .withColumn("_x", F.when(F.col("_t") == 0, first).when(F.col("_t") > 0, F.lit(weight) * value)))
    inner = Window.partitionBy(*keys, "_b").orderBy(rn).rowsBetween(Window.unboundedPreceding, 0)
    scaled = F.col("_x") * F.pow(F.lit(decay), -k)
    base = base.withColumn("_s", F.when(k.isNotNull(), F.sum(scaled).over(inner) * F.pow(F.lit(decay), k)))
    ends = (base.where(k == block - 1).select(*keys, (F.col("_b")).alias("_b"), F.col("_s").alias("_e")))
    w = Window.partitionBy(*keys).orderBy("_b")
    fade = decay ** block
    tail = sum((F.coalesce(F.lag("_e", j).over(w), F.lit(0.0)) * F.lit(fade ** j) for j in (1, 2, 3)), F.col("_e"))
    ends = ends.withColumn("_carry", tail).select(*keys, (F.col("_b") + 1).alias("_b"), "_carry")
    return (base.join(ends, [*keys, "_b"], "left")
            .withColumn(out, F.col("_s") + F.coalesce(F.col("_carry"), F.lit(0.0)) * F.pow(F.lit(decay), k + 1))
            .drop("_t", "_b", "_k", "_x", "_s", "_carry"))


def prefix_frames(df: DataFrame, keys: Sequence[str], values: dict[str, Column], back: int,
                  finish: Callable[[Callable[[str, int, int], Column]], dict[str, Column]],
                  rn: str = "rn", offsets: dict[str, Column] | None = None) -> DataFrame:
    """Long row frames as differences of running sums.

    A sliding frame of W rows costs W updates per row; a difference of two
    running sums costs one.  ``finish`` gets ``total(name, lo, hi)``, the sum of
    ``values[name]`` over rows t-lo .. t-hi, and returns the output columns.
    ``offsets`` are levels taken from each chunk's first row, to be subtracted
    inside ``values`` so that squares keep their precision.
    """
    def build(d, w):
        running = w.rowsBetween(Window.unboundedPreceding, 0)
        if offsets:
            whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            d = d.withColumns({n: F.first(c, ignorenulls=True).over(whole) for n, c in offsets.items()})
        d = d.withColumns({f"_p_{n}": F.sum(F.coalesce(c, F.lit(0.0))).over(running) for n, c in values.items()})
        cache: dict[tuple[str, int], str] = {}

        def prefix(name: str, k: int) -> Column:
            cache[(name, k)] = f"_l_{name}_{k}"
            return F.col(f"_l_{name}_{k}")

        outs = finish(lambda name, lo, hi: prefix(name, hi) - prefix(name, lo + 1))
        d = d.withColumns({alias: F.coalesce(F.lag(f"_p_{n}", k).over(w), F.lit(0.0)) if k
                           else F.col(f"_p_{n}") for (n, k), alias in cache.items()})
        d = d.withColumns(outs)
        return d.drop(*[f"_p_{n}" for n in values], *cache.values(), *(offsets or {}))

    return chunked(df, keys, rn, back + 1, 0, build)
