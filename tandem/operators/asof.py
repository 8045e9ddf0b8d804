"""As-of alignment: one union and one window instead of a chain of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tandem.functions.ordered import carry_forward
from tandem.functions.timeline import epoch_micros, epoch_seconds

DAY = 86_400
MINUTES = 1440
SLICE_ROWS = 50_000
MAX_UNIVERSE = 20_000


def universe_list(df: DataFrame, limit: int = MAX_UNIVERSE) -> list[str]:
    """Distinct symbols; refuses a result that is not universe-sized."""
    rows = df.select("symbol").where("symbol is not null").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} symbols: not a symbol universe")
    return sorted(r[0] for r in rows)


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], cols: Sequence[str],
              suffix: str = "", slice_secs: int = DAY, ts: str = "ts") -> DataFrame:
    """Latest right row at or before each left row (exact match allowed).

    Rows are cut by (key, time slice); the last right row of earlier slices is
    carried over, so no key is ever gathered whole.
    """
    payload = F.struct(*[F.col(c) for c in cols])
    kept = [c for c in left.columns if c not in (*by, ts)]
    lhs = left.select(*by, ts, F.lit(1).alias("_side"), F.struct(F.lit(1).alias("_x"), *kept).alias("_l"))
    rhs = right.select(*by, ts, F.lit(0).alias("_side"), payload.alias("_r"))
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    both = both.withColumn("_slice", F.floor(epoch_seconds(ts) / F.lit(slice_secs)))
    got = carry_forward(both, list(by), [ts, "_side"], "_slice", "_r", "_hit").where("_side = 1")
    return got.select(*by, ts, *[F.col("_l")[c].alias(c) for c in kept],
                      *[F.col("_hit")[c].alias(c + suffix) for c in cols])


def busy_slices(df: DataFrame, by: Sequence[str], micros: str, rows: int) -> DataFrame:
    """Adds ``_slice``, which grows with time: a day of a key, or a piece of a day that has more than ``rows`` rows.

    Days are cut between minutes, by a running count of the rows of each minute; a minute is never cut.
    """
    d = df.withColumn("_minute", F.floor(F.col(micros) / F.lit(60_000_000)))
    counts = (d.where("_minute is not null").groupBy(*by, "_minute").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_day", F.floor(F.col("_minute") / F.lit(MINUTES))))
    day = Window.partitionBy(*by, "_day")
    earlier = F.sum("_n").over(day.orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1))
    cuts = (counts.withColumns({"_all": F.sum("_n").over(day), "_cut": F.floor(F.coalesce(earlier, F.lit(0)) / F.lit(rows))})
            .where((F.col("_all") > rows) & (F.col("_cut") > 0)).select(*by, "_minute", "_cut"))
    start = F.floor(F.col("_minute") / F.lit(MINUTES)) * F.lit(1 << 24)
    return (d.join(cuts, [*by, "_minute"], "left")
            .withColumn("_slice", start + F.coalesce("_cut", F.lit(0))).drop("_minute", "_cut"))


def asof_match(left: DataFrame, right: DataFrame, by: Sequence[str], cols: Sequence[str], direction: str = "backward",
               tolerance: float | None = None, allow_exact: bool = True, suffix: str = "", ts: str = "ts",
               slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Each left row with the right row that is nearest in time: before it, after it, or on either side.

    ``tolerance`` is the greatest distance in seconds (None: any); without ``allow_exact`` a row of the same time does
    not count.  Of right rows at one time, "backward" takes the one with the greatest ``cols`` and "forward" the one
    with the least; "nearest" prefers the earlier of two equally distant rows.  Left rows without a match, or with a
    NULL key or time, stay with NULLs.

    Both directions share one exchange: each slice's last and first right rows are carried to the slices after and
    before it, and busy days are cut into several slices.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown direction {direction!r}")
    kept = [c for c in left.columns if c not in (*by, ts)]
    at = epoch_micros(ts).alias("_at")
    known = [F.col(c).isNotNull() for c in (*by, ts)]
    lhs = left.select(*by, ts, at, F.lit(True).alias("_is_left"), F.struct(F.lit(1).alias("_x"), *kept).alias("_l"))
    rhs = right
    for k in known:
        rhs = rhs.where(k)
    rhs = rhs.select(*by, ts, at, F.lit(False).alias("_is_left"), F.struct(at, *cols).alias("_r"))
    both = busy_slices(lhs.unionByName(rhs, allowMissingColumns=True), by, "_at", slice_rows)

    ends = both.where("_slice is not null").groupBy(*by, "_slice").agg(F.max("_r").alias("_last"), F.min("_r").alias("_first"))
    onward = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*by).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "_slice", F.last("_last", ignorenulls=True).over(onward).alias("_prev"),
                       F.last("_first", ignorenulls=True).over(back).alias("_next"))
    side = F.col("_is_left") if allow_exact else ~F.col("_is_left")
    inside = Window.partitionBy(*by, "_slice")
    upto = inside.orderBy("_at", side, "_r").rowsBetween(Window.unboundedPreceding, 0)
    down = inside.orderBy(F.desc("_at"), side, F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.join(ends, [*by, "_slice"], "left")
    before = F.coalesce(F.last("_r", ignorenulls=True).over(upto), F.col("_prev"))
    after = F.coalesce(F.last("_r", ignorenulls=True).over(down), F.col("_next"))
    if direction == "backward":
        found = found.withColumn("_hit", before)
    elif direction == "forward":
        found = found.withColumn("_hit", after)
    else:
        found = found.withColumns({"_b": before, "_f": after})
        nearer = (F.col("_f._at") - F.col("_at")) < (F.col("_at") - F.col("_b._at"))
        found = found.withColumn("_hit", F.when(F.col("_b").isNull() | nearer, F.coalesce("_f", "_b")).otherwise(F.col("_b")))
    fits = F.col("_at").isNotNull()
    if tolerance is not None:
        fits = fits & (F.abs(F.col("_hit._at") - F.col("_at")) <= F.lit(int(round(tolerance * 1_000_000))))
    return (found.where("_is_left").withColumn("_hit", F.when(fits, F.col("_hit")))
            .select(*by, ts, *[F.col("_l")[c].alias(c) for c in kept], *[F.col("_hit")[c].alias(c + suffix) for c in cols]))


def asof_align(bars: DataFrame, symbols: Sequence[str], anchor: str, cols: Sequence[str]) -> DataFrame:
    """Every symbol's latest bar at each bar time of the anchor symbol."""
    grid = (bars.where(F.col("symbol") == anchor).select("ts").distinct()
            .select("ts", F.explode(F.array(*[F.lit(s) for s in symbols])).alias("symbol")))
    return asof_join(grid, bars, ["symbol"], cols)


def outer_align(bars: DataFrame, symbols: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Union of all bar times for every symbol; a missing bar stays NULL."""
    grid = (bars.select("ts").distinct()
            .select("ts", F.explode(F.array(*[F.lit(s) for s in symbols])).alias("symbol")))
    return grid.join(bars.select("symbol", "ts", *cols), ["symbol", "ts"], "left")
