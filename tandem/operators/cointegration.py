"""Johansen and Engle-Granger cointegration of pairs.

The two-series one-lag Johansen test is 21 covariances and 2x2 algebra, so it
is one native aggregation.  Tests that need a lag search (ADF, many lags) run
as grouped maps over groups that a time horizon bounds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tandem.functions.timeline import epoch_seconds
from tandem.operators import clean
from tandem.operators.regression import (horizon_starts, leg_features, leg_pairs, pair_regressions,
                                         regress_windows, std_rate)

# Fixed critical values (95 %) of the trace and maximum-eigenvalue tests, constant term, two series.
TRACE_95 = (15.4943, 3.8415)
MAX_EIGEN_95 = (14.2639, 3.8415)


def johansen_moments(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Covariances of (now, previous difference, previous level) of both legs.

    Both lags lie inside the window: its first two rows give no observation.
    """
    inside = F.col("rn") - F.col("start_rn") >= 2
    u = {}
    for p in ("x", "y"):
        v, l1, l2 = (F.col(f"{p}_{c}") for c in ("v", "l1", "l2"))
        u[f"{p}0"], u[f"{p}z"], u[f"{p}k"] = v - l1, l1 - l2, l1
    d = rows.where(inside).withColumns({f"u_{k}": v for k, v in u.items()})
    names = ["x0", "y0", "xz", "yz", "xk", "yk"]
    aggs = [F.count(F.lit(1)).alias("t"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")]
    for a in range(6):
        for b in range(a, 6):
            aggs.append(F.covar_pop(f"u_{names[a]}", f"u_{names[b]}").alias(f"c_{names[a]}_{names[b]}"))
    return d.groupBy(*keys).agg(*aggs)


def johansen_from_moments(m: DataFrame) -> DataFrame:
    """Eigenvalues, trace statistics, rank and slope -c0/c1 out of the moments."""
    def c(a, b):
        order = ["x0", "y0", "xz", "yz", "xk", "yk"]
        a, b = sorted((a, b), key=order.index)
        return F.col(f"c_{a}_{b}")

    d = m.withColumn("_det", c("xz", "xz") * c("yz", "yz") - c("xz", "yz") * c("xz", "yz"))
    z = {("x", "x"): c("yz", "yz") / F.col("_det"), ("y", "y"): c("xz", "xz") / F.col("_det"),
         ("x", "y"): -c("xz", "yz") / F.col("_det"), ("y", "x"): -c("xz", "yz") / F.col("_det")}
    outs = {}
    for left in ("0", "k"):
        for right in ("0", "k"):
            if (left, right) == ("0", "k"):
                continue
            for a in "xy":
                for b in "xy":
                    part = sum((c(a + left, p + "z") * z[p, q] * c(q + "z", b + right) for p in "xy" for q in "xy"), F.lit(0.0))
                    outs[f"_s{left}{right}_{a}{b}"] = c(a + left, b + right) - part
    d = d.withColumns(outs)
    s = lambda n, a, b: F.col(f"_s{n}_{a}{b}")

    def inverse(n):
        det = s(n, "x", "x") * s(n, "y", "y") - s(n, "x", "y") * s(n, "y", "x")
        return {("x", "x"): s(n, "y", "y") / det, ("y", "y"): s(n, "x", "x") / det,
                ("x", "y"): -s(n, "x", "y") / det, ("y", "x"): -s(n, "y", "x") / det}

    i0, ik = inverse("00"), inverse("kk")
    g = {(a, b): sum((s("k0", a, p) * i0[p, q] * s("k0", b, q) for p in "xy" for q in "xy"), F.lit(0.0)) for a in "xy" for b in "xy"}
    d = d.withColumns({f"_g_{a}{b}": v for (a, b), v in g.items()})
    mm = {(a, b): sum((ik[a, p] * F.col(f"_g_{p}{b}") for p in "xy"), F.lit(0.0)) for a in "xy" for b in "xy"}
    d = d.withColumns({f"_m_{a}{b}": v for (a, b), v in mm.items()})
    half = (F.col("_m_xx") + F.col("_m_yy")) / 2
    root = F.sqrt(F.greatest(half * half - (F.col("_m_xx") * F.col("_m_yy") - F.col("_m_xy") * F.col("_m_yx")), F.lit(0.0)))
    d = d.withColumns({"lambda_0": half + root, "lambda_1": half - root})
    log0, log1 = F.log(1 - F.col("lambda_0")), F.log(1 - F.col("lambda_1"))
    d = d.withColumns({"trace_0": -F.col("t") * (log0 + log1), "trace_1": -F.col("t") * log1,
                       "maxeig_0": -F.col("t") * log0,
                       "slope": -F.col("_m_xy") / (F.col("lambda_0") - F.col("_m_xx"))})
    # The rank is the last statistic beyond its critical value, not a sequential test.
    rank = F.when(F.col("trace_1") > TRACE_95[1], 2).when(F.col("trace_0") > TRACE_95[0], 1).otherwise(0)
    d = d.withColumn("rank", rank)
    return d.drop(*[x for x in d.columns if x.startswith("_") or x.startswith("c_")])


def johansen(panel: DataFrame, days: Sequence[int], legs: DataFrame | None = None) -> DataFrame:
    """One-lag Johansen test of every pair over trailing windows of ``days``."""
    starts = horizon_starts(panel, days).agg(F.collect_list(F.struct("days", "start_rn", "start_ts", "end_ts")))  # one entry per horizon
    rows = leg_pairs(legs if legs is not None else leg_features(panel, hurst=False))
    rows = rows.withColumn("_h", F.explode(starts.scalar())).select(*rows.columns, "_h.*").where("rn >= start_rn")
    return johansen_from_moments(johansen_moments(rows, ["n1", "n2", "days", "start_rn", "start_ts", "end_ts"]))


def max_eigen_relations(tested: DataFrame) -> DataFrame:
    """Number of cointegrating relations by the maximum-eigenvalue test (the last statistic is that of the trace test)."""
    last, first = F.col("trace_1") > MAX_EIGEN_95[1], F.col("maxeig_0") > MAX_EIGEN_95[0]
    return tested.withColumn("relations", F.when(last, 2).when(first, 1).otherwise(0))


def js_candidates(panel: DataFrame, days: Sequence[int] = (14, 28, 42), max_hurst: float = 0.49,
                  max_halflife_hours: float = 6.5, interval_secs: float = 60.0,
                  ignored: Sequence[str] = (), tests: DataFrame | None = None) -> DataFrame:
    """Best Johansen horizon per pair with regressions on it and on its last half-life."""
    tests = tests if tests is not None else johansen(panel, days)
    # Picked by an aggregate: a filter on the rank would copy the whole algebra into itself.
    picked = F.max_by(F.struct("start_rn", "start_ts", "end_ts", "days", "slope"),
                      F.when(F.col("rank") > 0, F.struct(F.col("lambda_0"), -F.col("days"))))
    best = (tests.groupBy("n1", "n2").agg(picked.alias("_b")).where("_b is not null")
            .select("n1", "n2", "_b.start_rn", F.col("_b.days").alias("coint_days"), F.col("_b.slope").alias("s_0")))
    legs = leg_features(panel)
    one = regress_windows(legs, best, ["n1", "n2", "coint_days", "s_0"])
    one = one.select("n1", "n2", "coint_days", "s_0", F.col("s").alias("s_dayslr"), F.col("fast_s").alias("s_daysfast"),
                     std_rate().alias("std_rate"), F.col("he").alias("he_0"), F.col("halflife").alias("hl_bars_0"),
                     F.col("st").alias("std0"), F.col("i").alias("mean0"), "x_last", "y_last", "start", "end")
    good = one.where("hl_bars_0 > 0")
    total = panel.agg(F.max("rn") + 1)
    windows = good.select(
        "n1", "n2", F.greatest(total.scalar() - F.bround("hl_bars_0", 0).cast("bigint"), F.lit(0)).alias("start_rn"))
    two = regress_windows(leg_features(panel, hurst=False), windows, ["n1", "n2"], hurst=False).select(
        "n1", "n2", F.col("s").alias("s_hllr"), F.col("fast_s").alias("s_hlfast"))
    rows = (good.join(two, ["n1", "n2"]).withColumn("interval_secs", F.lit(float(interval_secs)))
            .withColumn("pair", F.concat_ws("_", "n1", "n2")))
    return clean.filter_models_js(rows, max_hurst, max_halflife_hours, ignored).orderBy("he_0", "pair")


# --- Engle-Granger -----------------------------------------------------------

# MacKinnon (1994) response surface with constant, by number of series.
MACKINNON = {
    1: dict(star=-1.61, low=-18.83, high=2.74, small=(2.1659, 1.4412, 0.038269),
            large=(1.7339, 0.93202, -0.12745, -0.010368)),
    2: dict(star=-2.62, low=-18.86, high=0.92, small=(2.92, 1.5012, 0.039796),
            large=(2.1945, 0.64695, -0.29198, -0.042377)),
}


def mackinnon_p(tau: float, series: int) -> float:
    k = MACKINNON[series]
    if tau > k["high"]:
        return 1.0
    if tau < k["low"]:
        return 0.0
    poly = k["small"] if tau <= k["star"] else k["large"]
    value = sum(c * tau ** j for j, c in enumerate(poly))
    return 0.5 * math.erfc(-value / math.sqrt(2.0))


def adf_t(series: np.ndarray, constant: bool) -> float:
    """Augmented Dickey-Fuller t statistic, lag length by AIC on a common sample.

    The nested regressions share one QR factorisation: each further lag lowers
    the residual sum by its squared projection.
    """
    n = len(series)
    fixed = 1 if constant else 0
    # n - 1 - lags rows and lags + 1 + fixed columns: at least two residual degrees of freedom are left
    top = min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - fixed - 1, (n - 4 - fixed) // 2)
    if top < 0 or np.ptp(series) == 0:
        return math.nan
    step = np.diff(series)

    def design(lags):
        y = step[lags:]
        cols = [series[lags:-1]] + [step[lags - j:len(step) - j] for j in range(1, lags + 1)]
        return y, np.column_stack(cols)

    y, x = design(top)
    full = np.column_stack([np.ones(len(y)), x]) if constant else x
    q, _ = np.linalg.qr(full)
    explained = np.cumsum((q.T @ y) ** 2)[fixed:]
    ssr = np.maximum(y @ y - explained, 1e-300)
    aic = len(y) * np.log(ssr / len(y)) + 2 * (np.arange(len(ssr)) + 1 + fixed)
    y, x = design(int(np.argmin(aic)))
    if constant:
        x = np.column_stack([x, np.ones(len(y))])
    inv = np.linalg.pinv(x.T @ x)
    beta = inv @ (x.T @ y)
    rest = y - x @ beta
    sigma2 = rest @ rest / (len(y) - x.shape[1])
    return float(beta[0] / math.sqrt(sigma2 * inv[0, 0]))


def engle_granger_p(dependent: np.ndarray, other: np.ndarray) -> float:
    """p value of no cointegration of ``dependent`` on ``other`` and a constant."""
    if len(dependent) < 10:
        return math.nan
    x = np.column_stack([other, np.ones(len(other))])
    beta, *_ = np.linalg.lstsq(x, dependent, rcond=None)
    resid = dependent - x @ beta
    spread = dependent - dependent.mean()
    if resid @ resid <= 100 * math.sqrt(np.finfo(float).eps) * (spread @ spread):  # collinear legs
        return 0.0
    return mackinnon_p(adf_t(resid, constant=False), 2)


def adf_p(series: np.ndarray) -> float:
    return mackinnon_p(adf_t(series, constant=True), 1)


def pearson_p(r: float, n: int) -> float:
    """Two-sided p of a correlation: regularised incomplete beta at 1 - r*r."""
    if n < 3 or not math.isfinite(r):
        return math.nan
    if abs(r) >= 1:
        return 0.0
    a, b, x = (n - 2) / 2.0, 0.5, 1.0 - r * r
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, 1.0 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + num * d)
            c = 1.0 + num / c
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    value = front * h
    return 1.0 - value if flip else value


def _pair_series(panel: DataFrame) -> DataFrame:
    x = panel.select(F.col("symbol").alias("n1"), "ts", "rn", F.col("close").alias("x"))
    y = panel.select(F.col("symbol").alias("n2"), "ts", F.col("close").alias("y"))
    return x.join(y, "ts").where("n1 < n2")


def coint_candidates(panel: DataFrame, days: Sequence[int] = (14, 28, 42)) -> DataFrame:
    """Engle-Granger p per horizon, their mean and minimum, for every pair.

    Horizons are trailing windows; a row of the panel enters the moments once, whatever the number of horizons.
    """
    from tandem.operators import adf
    windows = adf.horizon_windows(panel, days)

    def finish(n1, n2, moments):
        p = {w.name: m.coint_p() for w, m in zip(windows, moments)}
        return (n1, n2, *[p[str(d)] for d in days])

    got = adf.test_windows(panel, windows, "n1 string, n2 string, " + ", ".join(f"p_{d} double" for d in days), finish)
    starts = horizon_starts(panel, days).agg(F.map_from_entries(F.collect_list(F.struct("days", "start_ts"))))  # an entry a horizon
    cols = [F.col(f"p_{d}") for d in days]
    tested = F.array(*[F.when(c.isNotNull() & ~F.isnan(c), F.struct(c.alias("p"), F.lit(i).alias("i"), F.lit(d).alias("days"))) for i, (d, c) in enumerate(zip(days, cols))])
    best = F.array_min(F.array_compact(tested))
    return got.withColumn("_b", best).select(
        F.concat_ws("_", "n1", "n2").alias("pair"), *cols, (sum(cols[1:], cols[0]) / len(cols)).alias("p"), F.least(*cols).alias("pmin"),
        F.element_at(starts.scalar(), F.col("_b.days")).alias("start_of_pmin"))


def top_pairs(candidates: DataFrame, n: int = 100) -> DataFrame:
    return candidates.orderBy("p", "pair").limit(n)


def pair_tests(panel: DataFrame, days: int | None = None) -> DataFrame:
    """Stationarity of each leg, correlation with p, and cointegration, per pair; over the last ``days`` if given."""
    from tandem.operators import adf
    windows = adf.horizon_windows(panel, None if days is None else [days])

    def finish(n1, n2, moments):
        m = moments[0]
        return (n1, n2, m.stationary_p("x"), m.stationary_p("y"), *adf.pearson(m), m.coint_p())

    return adf.test_windows(panel, windows, "n1 string, n2 string, p_x double, p_y double, corr double, p_corr double, p_coint double", finish)


def coint_at_lag(panel: DataFrame, lag: int, days: Sequence[int] = (14, 28, 42)) -> DataFrame:
    """Dickey-Fuller t of the residual with a fixed number of differences, per pair and horizon (columns t_<days>)."""
    from tandem.operators import adf
    windows = adf.horizon_windows(panel, days)

    def finish(n1, n2, moments):
        t = {w.name: m.coint_t(lag) for w, m in zip(windows, moments)}
        return (n1, n2, *[t[str(d)] for d in days])

    return adf.test_windows(panel, windows, "n1 string, n2 string, " + ", ".join(f"t_{d} double" for d in days), finish, reach=lag + 1)


def coint_matrix(tests: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """Symmetric matrix of p values: one row per symbol, one column per symbol of the universe.

    Zero on the diagonal; NULL where a pair was not tested.
    """
    half = tests.select("n1", "n2", "p_coint")
    whole = half.unionByName(half.select(F.col("n2").alias("n1"), F.col("n1").alias("n2"), "p_coint"))
    own = F.col("n1")
    cells = [F.when(own == s, F.lit(0.0)).otherwise(F.max(F.when(F.col("n2") == s, F.col("p_coint")))).alias(s) for s in symbols]
    return whole.groupBy("n1").agg(*cells).withColumnRenamed("n1", "symbol")


def coint_pairs(tests: DataFrame, max_p: float = 0.05) -> DataFrame:
    """Pairs that the test calls cointegrated, the surest first (ties by name)."""
    return tests.select("n1", "n2", F.col("p_coint").alias("p")).where(F.col("p") <= max_p).orderBy("p", "n1", "n2")


def _window_groups(series: DataFrame, chunk_days: int, reach_days: int) -> DataFrame:
    """Give every row to each chunk of end days whose windows can reach it.

    Exploding to single windows would repeat a row once per window; a chunk of
    neighbouring end days shares its rows, so the repeat is reach/chunk + 1.
    """
    day = F.floor(epoch_seconds("ts") / 86_400)
    edge = lambda fn: series.agg(fn(day)).scalar()
    d = series.withColumns({"_day": day, "_last": edge(F.max), "_first": edge(F.min)})
    top = F.least(F.col("_day") + reach_days, F.col("_last") + 1)
    chunks = F.sequence(F.floor(F.col("_day") / chunk_days), F.floor(top / chunk_days))
    return d.withColumn("chunk", F.explode(chunks))


def coint_study(panel: DataFrame, days: Sequence[int] = (5, 7, 10, 14), max_p: float = 0.05,
                chunk_days: int = 7) -> DataFrame:
    """End dates at which a pair is cointegrated over both d and 2d days.

    An end date is the day after a trading day of the panel; for d days the first one follows the 2d-th trading day.
    """
    spans = list(days)
    # the calendar: one row a day
    day = F.floor(epoch_seconds("ts") / 86_400)
    calendar = panel.select(day.alias("_day")).distinct().withColumn("_nth", F.row_number().over(Window.orderBy("_day")))

    def test(keys: tuple, g: pd.DataFrame) -> pd.DataFrame:
        n1, n2, chunk = keys
        g = g.sort_values("ts")
        ts = g["ts"].to_numpy().astype("datetime64[us]")
        x, y = g["x"].to_numpy(), g["y"].to_numpy()
        nth = dict(zip(g["_day"].tolist(), g["_nth"].tolist()))
        out = []
        for end_day in range(chunk * chunk_days, (chunk + 1) * chunk_days):
            if end_day - 1 not in nth:
                continue
            end = np.datetime64(end_day, "D").astype("datetime64[us]")
            for d in spans:
                if nth[end_day - 1] < 2 * d:
                    continue
                p = []
                for k in (2 * d, d):
                    m = (ts >= end - np.timedelta64(k, "D")) & (ts <= end)
                    p.append(engle_granger_p(x[m], y[m]))
                if max(p) <= max_p:
                    out.append((n1, n2, d, pd.Timestamp(end), max(p)))
        return pd.DataFrame(out, columns=["n1", "n2", "d", "end", "p"])

    groups = _window_groups(_pair_series(panel), chunk_days, 2 * max(spans) + 1).join(calendar, "_day")
    return groups.groupBy("n1", "n2", "chunk").applyInPandas(
        test, "n1 string, n2 string, d int, end timestamp_ntz, p double")


def johansen_matrix(series: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (descending) and vectors of the test with ``lags`` differences."""
    step = np.diff(series, axis=0)
    z = np.column_stack([step[lags - j:len(step) - j] for j in range(1, lags + 1)]) if lags else None
    now, level = step[lags:], series[:len(series) - lags][1:] if lags else series[:-1]
    level = level[-len(now):]
    centre = lambda a: a - a.mean(axis=0)
    now, level = centre(now), centre(level)
    if z is not None:
        z = centre(z)
        q, _ = np.linalg.qr(z)
        now, level = now - q @ (q.T @ now), level - q @ (q.T @ level)
    t = len(now)
    s00, skk, sk0 = now.T @ now / t, level.T @ level / t, level.T @ now / t
    m = np.linalg.solve(skk, sk0 @ np.linalg.solve(s00, sk0.T))
    values, vectors = np.linalg.eig(m)
    order = np.argsort(values.real)[::-1]
    return values.real[order], vectors.real[:, order]


class SlidingMoments:
    """Running sums of the lagged products of two series, so that any window's moments are differences of two entries.

    With s the row of a difference d(s) = v(s) - v(s-1), ``steps[u, v, h]`` runs over du(s)*dv(s-h) and
    ``levels[u, v, q]`` over du(s+q)*v(s); entry k holds the sum over all rows before k.
    """

    def __init__(self, series: np.ndarray, max_lag: int):
        self.v = series - series.mean(axis=0)
        n = len(series)
        d = np.vstack([np.zeros((1, 2)), np.diff(self.v, axis=0)])
        grow = lambda a: np.concatenate([[0.0], np.cumsum(a)])
        self.steps = np.zeros((2, 2, max_lag + 1, n + 1))
        self.levels = np.zeros((2, 2, max_lag + 1, n + 1))
        for u in range(2):
            for w in range(2):
                for h in range(min(max_lag + 1, n)):
                    a, b = np.zeros(n), np.zeros(n)
                    a[h:] = d[h:, u] * d[:n - h, w]
                    b[:n - h] = d[h:, u] * self.v[:n - h, w]
                    self.steps[u, w, h], self.levels[u, w, h] = grow(a), grow(b)
        self.square = np.array([[grow(self.v[:, u] * self.v[:, w]) for w in range(2)] for u in range(2)])
        self.sum_v = np.array([grow(self.v[:, u]) for u in range(2)])

    def eigen(self, first: np.ndarray, last: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
        """Eigenvalues (falling) and vectors of the test with ``lag`` differences in windows of rows first .. last."""
        a, b = first + lag + 1, last  # rows of the differences that have all their lags
        rows = (b - a + 1)[:, None, None].astype(float)
        size = 2 * (lag + 1)
        i = np.arange(size)
        back, side = i // 2, i % 2
        low = np.minimum.outer(back, back)
        gap = np.abs(np.subtract.outer(back, back))
        # of the pair of variables the one further back in time is the lagged one
        u = np.where(np.less_equal.outer(back, back), side[:, None], side[None, :])
        w = np.where(np.less_equal.outer(back, back), side[None, :], side[:, None])
        total = lambda table, lo, hi: table[hi + 1] - table[lo]
        g = self.steps[u, w, gap, (b[:, None, None] - low + 1)] - self.steps[u, w, gap, (a[:, None, None] - low)]
        q = lag - back
        c = np.stack([self.levels[side, k, q, (b - lag + 1)[:, None]] - self.levels[side, k, q, (a - lag)[:, None]] for k in range(2)], axis=2)
        kk = np.array([[total(self.square[x, y], a - lag, b - lag) for y in range(2)] for x in range(2)]).transpose(2, 0, 1)
        step_sum = np.stack([self.v[b - k, x] - self.v[a - k - 1, x] for k, x in zip(back, side)], axis=1)
        level_sum = np.stack([total(self.sum_v[x], a - lag, b - lag) for x in range(2)], axis=1)
        g = g - step_sum[:, :, None] * step_sum[:, None, :] / rows
        c = c - step_sum[:, :, None] * level_sum[:, None, :] / rows
        kk = kk - level_sum[:, :, None] * level_sum[:, None, :] / rows
        s00, s0k, z = g[:, :2, :2], c[:, :2], g[:, 2:, 2:]
        if lag:
            solved = np.linalg.solve(z, np.concatenate([g[:, 2:, :2], c[:, 2:]], axis=2))
            s00 = s00 - g[:, :2, 2:] @ solved[:, :, :2]
            s0k = s0k - g[:, :2, 2:] @ solved[:, :, 2:]
            kk = kk - c[:, 2:].transpose(0, 2, 1) @ solved[:, :, 2:]
        m = np.linalg.solve(kk, s0k.transpose(0, 2, 1) @ np.linalg.solve(s00, s0k))
        values, vectors = np.linalg.eig(m)
        order = np.argsort(-values.real, axis=1)
        return np.take_along_axis(values.real, order, 1), np.take_along_axis(vectors.real, order[:, None, :], 2)


#: Windows that are solved together.
AT_ONCE = 64


def _solved(moments: SlidingMoments, first: np.ndarray, last: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``eigen``; NaN in windows without a solution (a leg that stands still, legs that move as one)."""
    try:
        return moments.eigen(first, last, lag)
    except np.linalg.LinAlgError:
        if len(first) == 1:
            return np.full((1, 2), math.nan), np.full((1, 2, 2), math.nan)
        parts = [_solved(moments, first[k:k + 1], last[k:k + 1], lag) for k in range(len(first))]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def rolling_johansen(panel: DataFrame, days: Sequence[int] = (10, 20, 30), step_hours: int = 1, max_lag: int = 64, chunk_days: int = 30,
                     stop_hours: int = 48, lags: Sequence[int] | None = None, all_windows: bool = False) -> DataFrame:
    """Maximum-eigenvalue test over stepped windows and lags 1, 2, 4 .. ``max_lag``.

    Rows with rank > 0 only, the windows in which a pair is cointegrated, or all.  Windows end every ``step_hours`` hours
    counted from 1970-01-01, so chunks share one grid, and at least ``stop_hours`` before the last bar; one with under
    ``4 * lag + 20`` bars is too short for a lag.  A group is a pair and ``chunk_days`` of window ends, with the rows that
    its longest window reaches; inside it running sums of lagged products serve every window and lag, so that a window
    costs one small matrix and not its rows again.
    """
    spans = list(days)
    lags = list(lags) if lags is not None else [2 ** k for k in range(int(math.log2(max_lag)) + 1)]

    def windows(ts: np.ndarray, chunk: int, first: np.datetime64, stop: np.datetime64):
        begin_hour = int(chunk) * chunk_days * 24
        hours = np.arange(-(-begin_hour // step_hours) * step_hours, begin_hour + chunk_days * 24, step_hours)
        ends = hours.astype("datetime64[h]").astype("datetime64[us]")
        ends = ends[ends <= stop]
        for d in spans:
            begins = ends - np.timedelta64(d, "D")
            fine = begins >= first
            yield d, ends[fine], np.searchsorted(ts, begins[fine], side="left"), np.searchsorted(ts, ends[fine], side="right") - 1

    def test(keys: tuple, g: pd.DataFrame) -> pd.DataFrame:
        n1, n2, chunk = keys
        g = g.sort_values("ts")
        ts = g["ts"].to_numpy().astype("datetime64[us]")
        first = np.datetime64(int(g["_first"].iloc[0]), "D")
        stop = g["_last_ts"].iloc[0].to_datetime64() - np.timedelta64(stop_hours, "h")
        moments, out = None, []
        for d, ends, lo, hi in windows(ts, chunk, first, stop):
            for lag in lags:
                for at in range(0, len(ends), AT_ONCE):
                    e, a, b = ends[at:at + AT_ONCE], lo[at:at + AT_ONCE], hi[at:at + AT_ONCE]
                    long = b - a + 1 >= 4 * lag + 20
                    if not long.any():
                        continue
                    e, a, b = e[long], a[long], b[long]
                    moments = moments or SlidingMoments(g[["x", "y"]].to_numpy(), max(lags))
                    values, vectors = _solved(moments, a, b, lag)
                    t = b - a - lag
                    with np.errstate(invalid="ignore", divide="ignore"):
                        stat = -t * np.log(np.maximum(1 - values[:, 0], 1e-300))
                        slope = -vectors[:, 0, 0] / vectors[:, 1, 0]
                    for k in np.flatnonzero((stat > MAX_EIGEN_95[0]) | all_windows):
                        out.append((n1, n2, d, lag, pd.Timestamp(e[k]), values[k, 0], stat[k], slope[k]))
        return pd.DataFrame(out, columns=["n1", "n2", "days", "lag", "end", "lambda_0", "maxeig_0", "slope"])

    groups = _window_groups(_pair_series(panel), chunk_days, max(spans) + 1).withColumn("_last_ts", panel.agg(F.max("ts")).scalar())
    return groups.groupBy("n1", "n2", "chunk").applyInPandas(
        test, "n1 string, n2 string, days int, lag int, end timestamp_ntz, lambda_0 double, maxeig_0 double, slope double")
