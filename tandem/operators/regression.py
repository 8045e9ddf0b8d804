"""Pair regressions from moments: one join on time, one aggregation, no per-pair sort.

All series stand on a shared time index (the aligned panel), so lags and
differences are properties of one symbol.  They are computed once per symbol;
a pair then only needs covariances of its two legs' columns, and every residual
statistic follows from them because the residual is linear in both legs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tandem.functions.ordered import chunked
from tandem.functions.timeline import minus_days

HURST_LAGS = range(2, 20)


def leg_features(panel: DataFrame, hurst: bool = True, value: str = "close") -> DataFrame:
    """Per symbol: value, neighbours, and differences to ``k`` rows earlier."""
    top = max(HURST_LAGS) if hurst else 2

    def build(d, w):
        v = F.col(value)
        cols = {"l1": F.lag(v, 1).over(w), "l2": F.lag(v, 2).over(w), "n1_": F.lead(v, 1).over(w)}
        if hurst:
            cols.update({f"d{k}": v - F.lag(v, k).over(w) for k in HURST_LAGS})
        return d.withColumns(cols)

    d = chunked(panel.select("symbol", "ts", "rn", F.col(value)), ["symbol"], "rn", top, 1, build)
    return d.withColumnRenamed(value, "v").withColumnRenamed("n1_", "nx")


def leg_pairs(legs: DataFrame) -> DataFrame:
    """All n1 < n2 at each time; the join key is the time, so no symbol is hot."""
    cols = [c for c in legs.columns if c not in ("symbol", "ts", "rn")]
    x = legs.select(F.col("symbol").alias("n1"), "ts", "rn", *[F.col(c).alias(f"x_{c}") for c in cols])
    y = legs.select(F.col("symbol").alias("n2"), "ts", *[F.col(c).alias(f"y_{c}") for c in cols])
    return x.join(y, "ts").where("n1 < n2")


def horizon_starts(panel: DataFrame, days: Sequence[int]) -> DataFrame:
    """(days, start_ts, start_rn, end_ts, end_rn) of the trailing windows of the panel."""
    end = panel.agg(F.max("ts")).scalar()
    parts = [F.struct(F.lit(d).alias("days"), F.min(F.when(F.col("ts") >= minus_days(end, d), F.col("ts"))).alias("start_ts"),
                      F.min(F.when(F.col("ts") >= minus_days(end, d), F.col("rn"))).alias("start_rn")) for d in days]
    row = panel.agg(F.max("ts").alias("end_ts"), F.max("rn").alias("end_rn"), F.array(*parts).alias("_h"))
    return row.select("end_ts", "end_rn", F.explode("_h").alias("_h")).select("_h.*", "end_ts", "end_rn")


def _spread_var(slope: Column, vx: str, cxy: str, vy: str) -> Column:
    return slope * slope * F.col(vx) - 2 * slope * F.col(cxy) + F.col(vy)


def pair_regressions(rows: DataFrame, keys: Sequence[str], hurst: bool = True) -> DataFrame:
    """Regression of y on x with residual statistics per key.

    ``rows`` come from :func:`leg_pairs` joined with windows that carry
    ``start_rn``; rows before the start are already left out.  The first row of
    a window repeats the second one's lag and difference.
    """
    first = F.col("rn") == F.col("start_rn")
    lag = lambda p: F.when(first, F.col(f"{p}_v")).otherwise(F.col(f"{p}_l1"))
    step = lambda p: F.when(first, F.col(f"{p}_nx") - F.col(f"{p}_v")).otherwise(F.col(f"{p}_v") - F.col(f"{p}_l1"))
    d = rows.withColumns({"xl": lag("x"), "yl": lag("y"), "xs": step("x"), "ys": step("y")})
    x, y = F.col("x_v"), F.col("y_v")
    aggs = [F.count(F.lit(1)).alias("bars"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"),
            F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"), F.covar_pop(x, y).alias("_cxy"),
            F.min("ts").alias("start"), F.max("ts").alias("end"),
            F.max_by(x, "rn").alias("x_last"), F.max_by(y, "rn").alias("y_last"),
            F.covar_pop("xl", "xs").alias("_h_xx"), F.covar_pop("xl", "ys").alias("_h_xy"),
            F.covar_pop("yl", "xs").alias("_h_yx"), F.covar_pop("yl", "ys").alias("_h_yy"),
            F.var_pop("xl").alias("_l_xx"), F.covar_pop("xl", "yl").alias("_l_xy"), F.var_pop("yl").alias("_l_yy")]
    if hurst:
        for k in HURST_LAGS:
            inside = F.col("rn") - F.col("start_rn") >= k
            xk, yk = F.when(inside, F.col(f"x_d{k}")), F.when(inside, F.col(f"y_d{k}"))
            aggs += [F.var_pop(xk).alias(f"_t_xx{k}"), F.covar_pop(xk, yk).alias(f"_t_xy{k}"), F.var_pop(yk).alias(f"_t_yy{k}")]
    g = d.groupBy(*keys).agg(*aggs)
    slope = F.col("s")
    g = g.withColumn("s", F.col("_cxy") / F.nullif(F.col("_vx"), F.lit(0.0)))
    g = g.withColumn("i", F.col("_my") - slope * F.col("_mx"))
    resid = F.greatest(_spread_var(slope, "_vx", "_cxy", "_vy"), F.lit(0.0))
    mean_xy, mean_xx = F.col("_cxy") + F.col("_mx") * F.col("_my"), F.col("_vx") + F.col("_mx") * F.col("_mx")
    drift = (slope * slope * F.col("_h_xx") - slope * (F.col("_h_xy") + F.col("_h_yx")) + F.col("_h_yy"))
    g = g.withColumns({
        "r": F.col("_cxy") / F.sqrt(F.nullif(F.col("_vx") * F.col("_vy"), F.lit(0.0))),
        "m": F.lit(0.0), "st": F.sqrt(F.try_divide(resid * F.col("bars"), F.col("bars") - 1)),
        "fast_s": F.try_divide(mean_xy, mean_xx),
        "_hl_slope": drift / F.nullif(_spread_var(slope, "_l_xx", "_l_xy", "_l_yy"), F.lit(0.0))})
    g = g.withColumn("fast_i", F.col("_my") - F.col("fast_s") * F.col("_mx"))
    g = g.withColumn("halflife", half_life(F.col("_hl_slope")))
    if hurst:
        # Slope of ln(tau) on ln(k): the k are fixed, so it is one weighted sum.
        logs = {k: math.log(k) for k in HURST_LAGS}
        mean = sum(logs.values()) / len(logs)
        spread = sum((v - mean) ** 2 for v in logs.values())
        g = g.withColumn("he", sum((F.lit((logs[k] - mean) / spread / 2) * F.log(F.greatest(
            _spread_var(slope, f"_t_xx{k}", f"_t_xy{k}", f"_t_yy{k}"), F.lit(0.0))) for k in HURST_LAGS), F.lit(0.0)))
    return g.drop(*[c for c in g.columns if c.startswith("_")])


def half_life(slope: Column) -> Column:
    """Bars until half of a deviation is gone, 2 decimals, half to even."""
    return F.bround(-F.log(F.lit(2.0)) / F.nullif(slope, F.lit(0.0)), 2)


def std_rate(st: str = "st", s: str = "s") -> Column:
    """Residual deviation in percent of the combined last price."""
    return F.try_divide(F.col(st), F.col("x_last") * F.col(s) + F.col("y_last")) * 100


def regress_windows(legs: DataFrame, windows: DataFrame, keys: Sequence[str], hurst: bool = True) -> DataFrame:
    """Regressions over per-pair windows ``windows(n1, n2, start_rn, ...)``.

    Pairs are formed by time first; the window table then only filters, so the
    T*N*N/2 rows are aggregated where they arise and never shuffled.
    """
    carried = [k for k in keys if k not in ("n1", "n2")]
    rows = leg_pairs(legs).join(windows.select("n1", "n2", "start_rn", *carried), ["n1", "n2"]).where("rn >= start_rn")
    return pair_regressions(rows, list(keys), hurst)


def regress_all(panel: DataFrame, keys: Sequence[str] = ("n1", "n2"), hurst: bool = True) -> DataFrame:
    rows = leg_pairs(leg_features(panel, hurst)).withColumn("start_rn", F.lit(0))
    return pair_regressions(rows, list(keys), hurst)


def rn_at_or_after(panel: DataFrame, targets: DataFrame, at: str, out: str) -> DataFrame:
    """Row number of the first panel time at or after each distinct ``at``.

    Looked up inside the day first, then at the next day with rows, so only the
    calendar (one row per day) meets an unpartitioned window.
    """
    times = panel.groupBy("ts").agg(F.first("rn").alias("rn")).withColumn("day", F.to_date("ts"))
    want = targets.select(at).distinct().withColumn("day", F.to_date(at))
    same = (want.join(times, "day").where(F.col("ts") >= F.col(at)).groupBy(at).agg(F.min("rn").alias("_same")))
    days = times.groupBy("day").agg(F.min("rn").alias("_first"))
    marks = days.unionByName(want, allowMissingColumns=True)
    later = Window.partitionBy(F.lit(0)).orderBy("day").rangeBetween(1, Window.unboundedFollowing)
    marks = marks.withColumn("day", F.datediff("day", F.lit("1970-01-01").cast("date")))
    nexts = marks.withColumn("_next", F.min("_first").over(later)).where(F.col(at).isNotNull()).select(at, "_next")
    return nexts.join(same, at, "left").select(at, F.coalesce("_same", "_next").alias(out))


def ols_models(panel: DataFrame, candidates: DataFrame) -> DataFrame:
    """Model row per candidate over the bars since ``start_of_pmin``."""
    first_rn = rn_at_or_after(panel, candidates, "start_of_pmin", "start_rn")
    windows = (candidates.join(first_rn, "start_of_pmin").withColumn("n1", F.split("pair", "_")[0])
               .withColumn("n2", F.split("pair", "_")[1]))
    got = regress_windows(leg_features(panel), windows, ["n1", "n2"])
    keep = got.select(F.concat_ws("_", "n1", "n2").alias("pair"), "s", "i", "m", "st", "halflife", F.col("he").alias("HE"))
    return keep.join(candidates, "pair")


def dated_models(panel: DataFrame, model_dates: DataFrame, days: int = 14) -> DataFrame:
    """Regression of every pair over the trailing ``days`` of every model date.

    The per-date loop of a study becomes a column: all dates are fitted in one
    aggregation over (pair, model_date).
    """
    ends = (panel.groupBy(F.to_date("ts").alias("day")).agg(F.max("ts").alias("end_ts"), F.max("rn").alias("end_rn"))
            .join(model_dates.select(F.col("model_date").alias("day")).distinct(), "day")
            .withColumn("_from", minus_days("end_ts", days)))
    starts = ends.join(rn_at_or_after(panel, ends, "_from", "start_rn"), "_from")
    # Every day of a window names its model date, so rows meet windows by day.
    windows = starts.select(F.col("day").alias("model_date"), "start_rn", "end_rn", "end_ts",
                            F.explode(F.sequence(F.to_date("_from"), F.col("day"))).alias("day"))
    rows = (leg_pairs(leg_features(panel)).withColumn("day", F.to_date("ts")).join(windows, "day").drop("day")
            .where("rn between start_rn and end_rn"))
    return pair_regressions(rows, ["n1", "n2", "model_date", "start_rn", "end_rn", "end_ts"])
