"""Window features of one symbol's bars. Bars carry a row number ``rn``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tandem.functions.ordered import chunked, ema_terms, prefix_frames

KEY = ("symbol",)


def lagged(df: DataFrame, value: str | Column, n: int, out: str, keys: Sequence[str] = KEY) -> DataFrame:
    """Value ``n`` rows earlier (later when negative)."""
    v = F.col(value) if isinstance(value, str) else value

    def build(d, w):
        return d.withColumn(out, F.lag(v, n).over(w) if n >= 0 else F.lead(v, -n).over(w))

    return chunked(df, keys, "rn", max(n, 0), max(-n, 0), build)


def framed(df: DataFrame, exprs: dict[str, Column], back: int, ahead: int = 0, exclude_current: bool = False,
           min_rows: int | None = None, keys: Sequence[str] = KEY) -> DataFrame:
    """Aggregates over the last ``back`` + 1 rows (without the current one if asked).

    A value appears from the ``min_rows``-th row of the key (default: full frame).
    """
    need = (min_rows if min_rows is not None else back + 1) - 1

    def build(d, w):
        frame = w.rowsBetween(-back, -1 if exclude_current else ahead)
        return d.withColumns({o: F.when(F.col("rn") >= need, e.over(frame)) for o, e in exprs.items()})

    return chunked(df, keys, "rn", back, ahead, build)


def log_return(bars: DataFrame, price: Column, out: str = "r") -> DataFrame:
    d = lagged(bars, price, 1, "_prev")
    return d.withColumn(out, F.log(F.try_divide(price, F.col("_prev")))).drop("_prev")


def ohlc4() -> Column:
    return (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4


def cumulative(df: DataFrame, value: str, out: str, slice_rows: int = 10_000) -> DataFrame:
    from tandem.functions.ordered import running_sum
    d = df.withColumn("_slice", F.floor(F.col("rn") / slice_rows))
    return running_sum(d, ["symbol"], ["rn"], "_slice", value, out).drop("_slice")


def fwd_return(bars: DataFrame, price: Column, out: str = "r") -> DataFrame:
    d = lagged(bars, price, -1, "_next")
    return d.withColumn(out, F.try_divide(F.col("_next"), price)).drop("_next")


def sma(bars: DataFrame, windows: Sequence[int], value: str = "close") -> DataFrame:
    """sma_<n> for each n, in one pass; NULL until n rows exist."""
    top = max(windows)

    def build(d, w):
        return d.withColumns({f"sma_{n}": F.when(F.col("rn") >= n - 1, F.avg(value).over(w.rowsBetween(-(n - 1), 0)))
                              for n in windows})

    return chunked(bars, KEY, "rn", top - 1, 0, build)


def rolling_std(bars: DataFrame, n: int, value: str | Column = "close") -> DataFrame:
    v = F.col(value) if isinstance(value, str) else value
    return framed(bars, {"std_samp": F.stddev_samp(v), "std_pop": F.stddev_pop(v)}, n - 1)


def ema(bars: DataFrame, n: int, value: str = "close", out: str = "ema") -> DataFrame:
    """Exponential average seeded at row n with the simple average of the first n."""
    seeded = framed(bars, {"_seed": F.avg(value)}, n - 1)
    return ema_terms(seeded, ["symbol"], F.col(value), 2.0 / (n + 1), n - 1, out, F.col("_seed")).drop("_seed")


def atr(bars: DataFrame, n: int = 14, out: str = "atr") -> DataFrame:
    """Wilder's average true range, seeded at row n with the mean of the first n ranges."""
    prev = lagged(bars, "close", 1, "_pc")
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_pc")),
                    F.abs(F.col("low") - F.col("_pc")))
    d = prev.withColumn("_tr", F.when(F.col("rn") >= 1, tr))
    d = framed(d, {"_seed": F.avg("_tr")}, n - 1, min_rows=n + 1)
    return ema_terms(d, ["symbol"], F.col("_tr"), 1.0 / n, n, out, F.col("_seed")).drop("_seed", "_tr", "_pc")


def _pair_moments(rows: DataFrame, keys: Sequence[str], window: int, outs) -> DataFrame:
    """Frames over the rows before each row from running sums of centred moments."""
    x, y = F.col("x_close") - F.col("_x0"), F.col("y_close") - F.col("_y0")
    values = {"n": F.lit(1.0), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}

    def finish(total):
        t = {k: total(k, window - 1, 1) for k in values}
        sxx = t["xx"] - t["x"] * t["x"] / t["n"]
        syy = t["yy"] - t["y"] * t["y"] / t["n"]
        sxy = t["xy"] - t["x"] * t["y"] / t["n"]
        return outs(t, sxx, syy, sxy)

    return prefix_frames(rows, keys, values, window, finish,
                         offsets={"_x0": F.col("x_close"), "_y0": F.col("y_close")})


def rolling_corr(pair_rows: DataFrame, n: int, keys: Sequence[str] = ("n1", "n2")) -> DataFrame:
    """Correlation over the n-1 rows before each row, from row n on."""
    return _pair_moments(pair_rows, keys, n, lambda t, sxx, syy, sxy: {
        "corr": F.when((F.col("rn") >= n - 1) & (sxx > 0) & (syy > 0), sxy / F.sqrt(sxx * syy))})


def rolling_linreg(pair_rows: DataFrame, window: int = 780, min_rows: int = 100,
                   keys: Sequence[str] = ("n1", "n2")) -> DataFrame:
    """Slope and intercept per bar from the rows before it, and the spread they give."""
    def outs(t, sxx, syy, sxy):
        slope = sxy / sxx
        level = F.col("_y0") + t["y"] / t["n"] - slope * (F.col("_x0") + t["x"] / t["n"])
        ready = (F.col("rn") >= min_rows - 1) & (sxx > 0)
        return {"slope": F.when(ready, slope), "intercept": F.when(ready, level)}

    d = _pair_moments(pair_rows, keys, window, outs)
    return d.withColumn("diff", F.col("intercept") + F.col("slope") * F.col("x_close") - F.col("y_close"))


def linreg_summary(rows: DataFrame, keys: Sequence[str] = ("n1", "n2")) -> DataFrame:
    """Mean, std and last z of the rolling spread, and the side outside two deviations."""
    d = rows.groupBy(*keys).agg(
        F.avg("diff").alias("m"), F.stddev_samp("diff").alias("std"), F.max_by("diff", "rn").alias("_d"),
        F.max_by("slope", "rn").alias("slope"), F.max_by("intercept", "rn").alias("i"),
        F.max_by("x_close", "rn").alias("x"), F.max_by("y_close", "rn").alias("y"))
    side = (F.when(F.col("_d") > F.col("m") + 2 * F.col("std"), 1)
            .when(F.col("_d") < F.col("m") - 2 * F.col("std"), -1).otherwise(0))
    return d.withColumn("z", F.try_divide(F.col("_d") - F.col("m"), F.col("std"))).withColumn("side", side).drop("_d")


def sma_cross_signal(bars: DataFrame, fast: int = 5, slow: int = 15) -> DataFrame:
    """+1 enter when close > sma > slow sma, -1 exit when close < sma < slow sma."""
    d = sma(bars, [fast, slow])
    f, s, c = F.col(f"sma_{fast}"), F.col(f"sma_{slow}"), F.col("close")
    return d.withColumn("signal", F.when((c > f) & (f > s), 1).when((c < f) & (f < s), -1).otherwise(0))
