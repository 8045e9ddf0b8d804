"""Spread of a pair model and its features over warm-up and test rows.

Feature groups are one pair and one model date: the look-back bars before the
test start plus the test range, so a group is bounded by the model window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tandem.functions.ordered import chunked, range_totals, running_extremes
from tandem.functions.timeline import epoch_seconds

FEATURES = ("mean0 double, std0 double, mean double, mean_half double, ema double, ema_half double, ema_quarter double, "
            "ema_5bars double, em_var double, em_var_half double, em_var_quarter double, em_var_5bars double, std double, "
            "sm_std_5 double, sm_std_10 double, sm_std_20 double, diffH double, diffL double, stdH double, stdL double, "
            "avg_diffdiff double, z double")
MODEL_KEYS = ("n1", "n2", "model_date")


def typical_price() -> Column:
    return (F.col("close") + F.col("high") + F.col("low")) / 3


def on_model_days(rows: DataFrame, models: DataFrame, start: str = "model_start_ts", end: str = "end_test_ts") -> DataFrame:
    """Pair rows beside each model whose days (from ``start`` to ``end``) they fall on.

    The days of a model are part of the join key, so a row meets the models that are in use on its day and not every
    model date of its pair; the caller cuts the two border days to the exact times.
    """
    day = F.explode(F.sequence(F.to_date(start), F.to_date(end))).alias("_day")
    return rows.withColumn("_day", F.to_date("ts")).join(models.select("*", day), ["n1", "n2", "_day"]).drop("_day")


def spread(models: DataFrame, bars: DataFrame) -> DataFrame:
    """p1, p2 and diff = slope*p1 - p2 of every model at its legs' common times, from the model start to the test end.

    Legs meet by time before the models join, and the model table is the small
    side; what it carries (slope, windows) stays on the row.
    """
    p = bars.select("symbol", "ts", "rn", typical_price().alias("p"))
    x = p.select(F.col("symbol").alias("n1"), "ts", "rn", F.col("p").alias("p1"))
    y = p.select(F.col("symbol").alias("n2"), "ts", F.col("p").alias("p2"))
    rows = on_model_days(x.join(y, "ts").where("n1 < n2"), models).where("rn >= start_rn and ts < end_test_ts")
    return rows.withColumn("diff", F.col("slope") * F.col("p1") - F.col("p2"))


def lookback(hl: str = "halflife") -> Column:
    """Look-back bars: four times the whole half-life plus one bar."""
    return (4 * (F.floor(F.col(hl)) + 1)).cast("bigint")


def warm_start(rows: DataFrame) -> DataFrame:
    """Mark the role of a model's rows.

    ``history`` feeds the long window, the last ``lookback`` rows before the
    test start warm the short ones, rows at or after ``start_ts`` are the test.
    """
    test = F.col("ts") >= F.col("start_ts")
    warm = ~test & (F.col("rn") > F.col("end_rn") - F.col("lookback"))
    return rows.withColumn("role", F.when(test, 2).when(warm, 1).otherwise(0))


def _recursive(x: pd.Series, n: int) -> tuple[pd.Series, pd.Series]:
    """Exponential mean seeded by the first value and variance seeded by the first step."""
    weight = 2.0 / (1.0 + n)
    mean = x.ewm(alpha=weight, adjust=False).mean()
    miss = (x - mean.shift()) ** 2
    var = miss.iloc[1:].ewm(alpha=weight, adjust=False).mean()
    return mean, var.reindex(x.index).fillna(0.0)


def features_of(g: pd.DataFrame) -> pd.DataFrame:
    """All spread features of one model's ordered rows (test rows only)."""
    g = g.sort_values("rn").reset_index(drop=True)
    look = int(g["lookback"].iloc[0])
    span = (g["end_ts"].iloc[0] - g["model_start_ts"].iloc[0]).total_seconds()
    long = pd.Series(g["diff"].to_numpy(), index=pd.DatetimeIndex(g["ts"]))
    window = pd.Timedelta(seconds=span)
    g["mean0"] = long.rolling(window, closed="both").mean().to_numpy()
    g["std0"] = long.rolling(window, closed="both").std().to_numpy()
    d = g[g["role"] > 0].reset_index(drop=True)
    x = d["diff"]
    half = max(look // 2, 5)
    quarter = max((look // 2) // 2, 5)
    for name, n in (("", look), ("_half", half), ("_quarter", quarter), ("_5bars", 5)):
        d["ema" + name], d["em_var" + name] = _recursive(x, n)
    test = d["role"] == 2
    size = np.minimum(np.arange(1, len(d) + 1), look + 1)
    d["mean"] = x.rolling(look + 1, min_periods=1).mean()
    total = np.concatenate([[0.0], np.cumsum(x.to_numpy() - x.iloc[0])])
    newest = size // 2
    at = np.arange(1, len(d) + 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        d["mean_half"] = (total[at] - total[at - newest]) / newest + x.iloc[0]
        d["z"] = (d["ema_5bars"] - d["ema"]) / np.sqrt(d["em_var"])
    d["std"] = x.rolling(look + 1, min_periods=2).std()
    d["avg_diffdiff"] = x.diff().abs().rolling(5, min_periods=1).mean()
    d.loc[~test, ["std", "mean", "mean_half"]] = np.nan
    d.loc[~test, "z"] = 0.0
    positive = d["std"].where(d["std"] > 0)
    for n in (5, 10, 20):
        d[f"sm_std_{n}"] = positive.rolling(n, min_periods=1).mean()
    seen = x.where(test)
    d["diffH"], d["diffL"] = seen.cummax(), seen.cummin()
    d["stdH"], d["stdL"] = d["std"].cummax(), d["std"].cummin()
    d["zp1"], d["zp2"], d["zp3"] = (d["z"].shift(k) for k in (1, 2, 3))
    return d[test]


def spread_features(rows: DataFrame) -> DataFrame:
    """Feature row per test bar of every (pair, model date)."""
    schema = ("n1 string, n2 string, model_date date, ts timestamp_ntz, rn bigint, p1 double, p2 double, diff double, "
              + FEATURES)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return features_of(g)[names]

    need = rows.select("n1", "n2", "model_date", "ts", "rn", "p1", "p2", "diff", "lookback", "end_ts",
                       "model_start_ts", "role")
    return need.groupBy(*MODEL_KEYS).applyInPandas(run, schema)


def long_window_stats(rows: DataFrame, secs: int, keys=("n1", "n2")) -> DataFrame:
    """Mean and deviation of the spread over the trailing ``secs`` seconds, inclusive.

    Sums are taken around each chunk's first spread to keep the squares small.
    """
    x = F.col("diff") - F.col("_d0")

    def finish(t):
        var = (t["xx"] - t["x"] * t["x"] / t["n"]) / (t["n"] - 1)
        return {"mean0": F.col("_d0") + t["x"] / t["n"],
                "std0": F.when(t["n"] > 1, F.sqrt(F.greatest(var, F.lit(0.0))))}

    return range_totals(rows.withColumn("_t", epoch_seconds("ts")), list(keys), "_t", secs,
                        {"n": F.lit(1), "x": x, "xx": x * x}, finish, size=max(secs, 7 * 86_400),
                        offsets={"_d0": F.col("diff")}).drop("_t")


def run_high_low(rows: DataFrame, value: str, keys=("symbol",), slice_rows: int = 10_000) -> DataFrame:
    """Highest and lowest value so far, per key over its whole history."""
    d = rows.withColumn("_slice", F.floor(F.col("rn") / slice_rows))
    return running_extremes(d, list(keys), ["rn"], "_slice", {f"{value}H": (value, "max"), f"{value}L": (value, "min")}).drop("_slice")


def z_simple(x: str = "x", y: str = "y") -> Column:
    return F.try_divide(F.col(x) * F.col("s") + F.col("i") - F.col(y) - F.col("m"), F.col("st"))


def std_percent() -> Column:
    return (F.col("std") - F.col("stdL")) / F.nullif(F.col("stdH") - F.col("stdL"), F.lit(0.0))


# Fixed thresholds of the cross-in signal.
Z_LOW, Z_HIGH = 1.7, 2.0


def cross_in(rows: DataFrame, keys=MODEL_KEYS, z: str = "z") -> DataFrame:
    """+1 when z falls back inside the upper band after coming down from outside, -1 mirrored."""
    def build(d, w):
        back = [F.col(z)] + [F.lag(z, k).over(w) for k in (1, 2, 3)]
        z0, z1, z2, z3 = back
        down, up = (z1 <= z2) & (z2 <= z3), (z1 >= z2) & (z2 >= z3)
        return d.withColumn("cross", F.when(z0.between(Z_LOW, Z_HIGH) & (z1 > Z_HIGH) & down, 1)
                            .when(z0.between(-Z_HIGH, -Z_LOW) & (z1 < -Z_HIGH) & up, -1).otherwise(0))

    return chunked(rows, list(keys), "rn", 3, 0, build)


# --- sizing and profit ----------------------------------------------------------

TRADE_AMOUNT = 10_000.0
FEE_PER_SHARE = 0.01


def size_pair(x: Column, y: Column, slope: Column, direction: Column, amount: float = TRADE_AMOUNT) -> tuple[Column, Column]:
    """Signed shares of both legs: the second leg takes the amount unless the first exceeds it."""
    by_y, by_x = F.round(F.lit(amount) / y), F.round(F.lit(amount) / x)
    over = F.round(by_y * slope) * x > amount
    px = F.when(over, by_x).otherwise(F.round(by_y * slope))
    py = F.when(over, F.round(by_x / slope)).otherwise(by_y)
    return (F.when(direction > 0, -px).otherwise(px).cast("bigint"),
            F.when(direction > 0, py).otherwise(-py).cast("bigint"))


def pair_pnl(x0: Column, x1: Column, pos_x: Column, y0: Column, y1: Column, pos_y: Column) -> Column:
    return (x1 - x0) * pos_x + (y1 - y0) * pos_y - FEE_PER_SHARE * (F.abs(pos_x) + F.abs(pos_y))


def pair_return(x0: Column, x1: Column, pos_x: Column, y0: Column, y1: Column, pos_y: Column) -> Column:
    """Profit in percent of the larger leg at entry."""
    gain = (x1 - x0) * pos_x + (y1 - y0) * pos_y
    return F.try_divide(gain, F.greatest(F.abs(pos_x * x0), F.abs(pos_y * y0))) * 100


def profit_cap(mean: Column, z: Column, std: Column) -> Column:
    return mean + 0.25 * z * std
