"""Rolling historical volatility, volatility cones and quantile ranks.

A window of W bars is reported from bar W on and covers the W-1 bars before the
current one; terms that need the bar before lose one more.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tandem.functions.ordered import chunked, ema_terms, prefix_frames
from tandem.functions.quantiles import exact_quantiles
from tandem.operators.features import lagged

# Bars per trading hour by interval, and session hours by market.
HOURS = {"us": 6.5, "hk": 5.5}
BARS_PER_HOUR = {"1h": 1, "30m": 2, "15m": 4, "5m": 12, "3m": 20, "1m": 60}
CONE_DAYS = (1, 3, 5, 10, 20, 40, 80, 120, 250)
EWMA_ALPHA = 0.06
RANK_GRID = tuple(round(0.05 * k, 2) for k in range(1, 21))


def bars_per_day_column(interval: Column, market: Column) -> Column:
    """Bars of an interval in one session, as a lookup expression."""
    hours = F.when(market == "hk", F.lit(HOURS["hk"])).otherwise(F.lit(HOURS["us"]))
    per_hour = F.create_map(*[F.lit(v) for kv in BARS_PER_HOUR.items() for v in kv])
    return F.when(interval == "1d", F.lit(1.0)).otherwise(hours * per_hour[interval])


def annualize(interval: Column, market: Column) -> Column:
    return F.sqrt(252 * bars_per_day_column(interval, market))


def window_bars(days: int, interval: str, market: str = "us") -> int:
    return int(HOURS[market] * days * BARS_PER_HOUR[interval])


def _prepare(bars: DataFrame, weighted: bool) -> DataFrame:
    d = lagged(bars, F.struct("open", "close"), 1, "_prev")
    d = d.withColumn("_co", F.log(F.col("close") / F.col("open")))
    for power, out in ((1, "_e1"), (2, "_e2")) if weighted else ():
        x = F.pow(F.col("_co"), F.lit(power))
        d = ema_terms(d, ["symbol"], x, EWMA_ALPHA, 0, out, seed=EWMA_ALPHA * x)
    return d


def rolling_volatility(bars: DataFrame, windows: dict[str, int], scale: float = 1.0,
                       estimators: Sequence[str] = ("parkinson", "garman_klass", "yang_zhang", "ewma")) -> DataFrame:
    """Columns ``<estimator>_<label>`` for each labelled window, all in one pass."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    hl = F.pow(F.log(h / l), 2)
    cc = F.log(c / F.col("_prev.close"))
    oo = F.log(o / F.col("_prev.open"))
    values = {"hl2": hl, "cc1": cc, "cc2": cc * cc, "oo1": oo, "oo2": oo * oo,
              "rs": F.log(h / c) * F.log(h / o) + F.log(l / c) * F.log(l / o)}
    d = _prepare(bars, "ewma" in estimators)
    top = max(windows.values())

    def finish(total):
        outs = {}
        for label, w in windows.items():
            n = w - 1
            if n < 2:
                outs.update({f"{e}_{label}": F.lit(None).cast("double") for e in estimators})
                continue
            ready = F.col("rn") >= w - 1

            def var(one, two):
                m = n - 1
                return (total(two, w - 2, 1) - F.pow(total(one, w - 2, 1), 2) / m) / (m - 1)

            built = {}
            built["parkinson"] = lambda: F.sqrt(F.greatest(total("hl2", w - 1, 1), F.lit(0.0)) / (4 * n * math.log(2)))
            built["garman_klass"] = lambda: F.sqrt(F.greatest(
                total("hl2", w - 1, 1) / 2 / n - (2 * math.log(2) - 1) * total("cc2", w - 2, 1) / n, F.lit(0.0)))
            k = 0.34 / (1.34 + (n + 1) / (n - 1))
            built["yang_zhang"] = lambda: F.sqrt(F.greatest(
                var("oo1", "oo2") + k * var("cc1", "cc2") + (1 - k) * total("rs", w - 1, 1) / n, F.lit(0.0)))
            for e in estimators:
                if e in built:
                    outs[f"{e}_{label}"] = F.when(ready, built[e]() * scale)
        return outs

    d = prefix_frames(d, ["symbol"], values, top, finish)
    if "ewma" in estimators:
        d = _with_ewma(d, windows, scale, top)
    return d.drop("_prev", "_co", "_e1", "_e2")


def _with_ewma(d: DataFrame, windows: dict[str, int], scale: float, top: int) -> DataFrame:
    """Bias-corrected exponentially weighted deviation of ln(close/open).

    The weighted sum over a window is the unbounded one less its own value a
    window earlier, decayed.
    """
    decay = 1 - EWMA_ALPHA

    def build(x, w):
        outs = {}
        for label, size in windows.items():
            n = size - 1
            if n < 2:
                outs[f"ewma_{label}"] = F.lit(None).cast("double")
                continue
            s0 = (1 - decay ** n) / (1 - decay)
            sw2 = (1 - decay ** (2 * n)) / (1 - decay ** 2)
            part = lambda c: (F.lag(c, 1).over(w) - decay ** n * F.coalesce(F.lag(c, n + 1).over(w), F.lit(0.0))) / EWMA_ALPHA
            s1, s2 = part("_e1"), part("_e2")
            variance = (s2 / s0 - F.pow(s1 / s0, 2)) * (s0 * s0 / (s0 * s0 - sw2))
            outs[f"ewma_{label}"] = F.when(F.col("rn") >= size - 1, F.sqrt(F.greatest(variance, F.lit(0.0))) * scale)
        return x.withColumns(outs)

    return chunked(d, ["symbol"], "rn", top + 1, 0, build)


def volatility_long(wide: DataFrame, windows: dict[str, int], estimators: Sequence[str]) -> DataFrame:
    """(symbol, ts, rn, estimator, horizon, sigma), empty windows left out."""
    entries = F.array(*[F.struct(F.lit(e).alias("estimator"), F.lit(h).alias("horizon"),
                                 F.col(f"{e}_{h}").alias("sigma")) for e in estimators for h in windows])
    return (wide.select("symbol", "ts", "rn", F.explode(entries).alias("_v"))
            .select("symbol", "ts", "rn", "_v.*").where("sigma is not null"))


def vol_cone(long: DataFrame) -> DataFrame:
    """Description of each rolling series: one cone point per symbol, estimator, horizon."""
    from tandem.operators.aggregates import describe_series
    return describe_series(long, ["symbol", "estimator", "horizon"], "sigma")


def nearest_rank(value: Column, grid: Column) -> Column:
    """q of the grid entry (array of struct(q, v)) nearest to value; lower q on ties."""
    scored = F.transform(grid, lambda g: F.struct(F.abs(g["v"] - value).alias("d"), g["q"].alias("q")))
    return F.array_min(scored)["q"]


def quantile_grid(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float] = RANK_GRID) -> DataFrame:
    """One array of (q, v) per key; the grid length bounds it."""
    q = exact_quantiles(df, keys, value, qs)
    return q.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("q", F.col("quantile").alias("v")))).alias("_grid"))


def vol_cone_rank(long: DataFrame) -> DataFrame:
    """Nearest 5 % quantile of the latest value of each rolling series."""
    keys = ["symbol", "estimator", "horizon"]
    last = long.groupBy(*keys).agg(F.max_by("sigma", "rn").alias("sigma"))
    return (last.join(quantile_grid(long, keys, "sigma"), keys)
            .withColumn("q", nearest_rank(F.col("sigma"), F.col("_grid"))).drop("_grid"))


def quantile_rank_series(df: DataFrame, keys: Sequence[str], value: str, out: str = "q") -> DataFrame:
    """Nearest 5 % quantile of every row's value within its key's whole series."""
    grid = quantile_grid(df, keys, value)
    return (df.join(grid, list(keys)).withColumn(out, nearest_rank(F.col(value), F.col("_grid"))).drop("_grid"))
