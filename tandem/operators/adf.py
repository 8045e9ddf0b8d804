"""Augmented Dickey-Fuller and Engle-Granger tests out of additive moments.

A test with a search over lags needs the products of a series with itself up to some thirty rows back.  For a residual
x - b*y - a these follow from the products of the legs: sums over t of x(t)*y(t-h), y(t)*x(t-h), x(t)*x(t-h) and
y(t)*y(t-h).  The last two belong to one symbol; the first two are sums of columns where the legs meet by time, combined
before the shuffle.  So no pair's series is gathered anywhere: a pair is some seventy numbers for each slice of time.
Slices are disjoint and their sums are additive, so a row enters once however many horizons it lies in.

What the sums hold too much at the ends of a window is corrected by the few rows of each symbol around these ends.  The
moment matrix of (level, differences .. , step) then has one Cholesky factor, whose last row gives the residual sum for
every lag at once; the chosen lag is fitted again on its own, longer sample from the same sums.

All series stand on a shared time index (the aligned panel), as in ``operators.regression``.  Levels are taken around a
level of each symbol, so that products keep their digits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tandem.functions.ordered import chunked
from tandem.operators.cointegration import mackinnon_p, pearson_p

SUMS = "array<struct<slice:int,n:bigint,sums:array<double>>>"


def top_lag(n: int, constant: bool) -> int:
    """Longest lag that is tried for ``n`` rows; at least two residual degrees of freedom are left."""
    fixed = int(constant)
    return min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - fixed - 1, (n - 4 - fixed) // 2)


@dataclass(frozen=True)
class Window:
    """A trailing window: its name, first and last row number; ``slice`` k means rows of windows k and longer."""

    name: str
    start_rn: int
    end_rn: int

    @property
    def n(self) -> int:
        return self.end_rn - self.start_rn + 1


class Lagged:
    """Products of one series with itself inside a window: ``s[h]`` = sum over t >= h of v(t)*v(t-h)."""

    def __init__(self, s: np.ndarray, total: float, head: np.ndarray, tail: np.ndarray, n: int):
        self.s, self.total, self.head, self.tail, self.n = s, total, head, tail, n

    def matrix(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of v(t-i)*v(t-j) and of v(t-i) over t = m .. n-1, for i, j = 0 .. m."""
        head, tail = self.head, self.tail
        g = np.empty((m + 1, m + 1))
        g[0] = [self.s[j] - head[j:m] @ head[:m - j] for j in range(m + 1)]
        g[:, 0] = g[0]
        for i in range(m):
            g[i + 1, i + 1:] = g[i, i:-1] + head[m - 1 - i] * head[m - 1 - i::-1][:m - i] - tail[i] * tail[i:m]
            g[i + 1:, i + 1] = g[i + 1, i + 1:]
        means = np.array([self.total - head[:m - i].sum() - tail[:i].sum() for i in range(m + 1)])
        return g, means

    def design(self, lag: int, constant: bool) -> tuple[np.ndarray, int]:
        """Moment matrix of (level, ``lag`` differences, step) over the longest sample of that lag, and its rows."""
        g, sums = self.matrix(lag + 1)
        rows = self.n - lag - 1
        if constant:
            g = g - np.outer(sums, sums) / rows
        turn = np.zeros((lag + 2, lag + 2))
        turn[0, 1] = 1.0
        for k in range(1, lag + 1):
            turn[k, k], turn[k, k + 1] = 1.0, -1.0
        turn[-1, 0], turn[-1, 1] = 1.0, -1.0
        return turn @ g @ turn.T, rows


def adf_t_of(series: Lagged, constant: bool) -> float:
    """Dickey-Fuller t statistic; the lag by the information criterion on a common sample."""
    fixed = int(constant)
    top = top_lag(series.n, constant)
    if top < 0:
        return math.nan
    m, rows = series.design(top, constant)
    try:
        last = np.linalg.cholesky(m)[-1]
    except np.linalg.LinAlgError:
        return math.nan
    explained = last[:-1] ** 2
    ssr = last[-1] ** 2 + explained[::-1].cumsum()[::-1]  # of no lag, one lag .. : what later regressors explain is still in
    ssr = np.maximum(np.append(ssr[1:], last[-1] ** 2), 1e-300)
    lag = int(np.argmin(rows * np.log(ssr / rows) + 2 * (np.arange(len(ssr)) + 1 + fixed)))
    return t_at(series, lag, constant)


def t_at(series: Lagged, lag: int, constant: bool) -> float:
    """The t statistic of the level with a given number of differences."""
    m, rows = series.design(lag, constant)
    inverse = np.linalg.pinv(m[:-1, :-1], hermitian=True)
    beta = inverse @ m[:-1, -1]
    sigma2 = (m[-1, -1] - beta @ m[:-1, -1]) / (rows - (lag + 1 + int(constant)))
    return float(beta[0] / math.sqrt(sigma2 * inverse[0, 0])) if sigma2 > 0 and inverse[0, 0] > 0 else math.nan


def _lagged_legs(panel: DataFrame, windows: Sequence[Window], reach: int) -> DataFrame:
    """Per symbol and time: slice, and the values at 0 .. ``reach`` rows before (fewer where the first window begins)."""
    first = max(windows, key=lambda w: w.n).start_rn
    rows = panel.where(F.col("rn") >= first).select("symbol", "ts", "rn", F.col("close").cast("double").alias("v"))
    level = rows.groupBy("symbol").agg(F.avg("v").alias("_level"))
    rows = rows.join(level, "symbol").withColumn("v", F.col("v") - F.col("_level"))
    part = F.lit(len(windows) - 1)
    for k in range(len(windows) - 2, -1, -1):
        part = F.when(F.col("rn") >= windows[k].start_rn, k).otherwise(part)
    back = lambda d, w: d.withColumn("lags", F.reverse(F.collect_list("v").over(w.rowsBetween(-reach, 0))))
    return chunked(rows.withColumn("slice", part), ["symbol"], "rn", reach, 0, back).drop("_level")


def _moments(rows: DataFrame, keys: Sequence[str], products: list) -> DataFrame:
    """One array of sums for each key and slice, gathered to one row a key (a few slices)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    sums = rows.groupBy(*keys, "slice").agg(F.count(F.lit(1)).alias("n"), *[total(c).alias(f"_s{i}") for i, c in enumerate(products)])
    packed = F.struct("slice", "n", F.array(*[f"_s{i}" for i in range(len(products))]).alias("sums"))
    return sums.groupBy(*keys).agg(F.sort_array(F.collect_list(packed)).alias("m"))


def pair_moments(panel: DataFrame, windows: Sequence[Window], reach: int) -> DataFrame:
    """(n1, n2) with the sums of both legs and of their products, and the legs' rows around the ends of the windows."""
    legs = _lagged_legs(panel, windows, reach)
    lag = lambda side, h: F.get(f"{side}lags", F.lit(h))
    own = _moments(legs, ["symbol"], [F.col("v"), *[F.col("v") * lag("", h) for h in range(reach + 1)]])
    near = F.lit(False)
    for w in windows:
        near = near | F.col("rn").between(w.start_rn - reach, w.start_rn + reach) | F.col("rn").between(w.end_rn - reach, w.end_rn)
    ends = legs.where(near).groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("rn", "v"))).alias("ends"))
    symbols = own.join(ends, "symbol")
    x = legs.select(F.col("symbol").alias("n1"), "ts", "slice", F.col("lags").alias("x_lags"))
    y = legs.select(F.col("symbol").alias("n2"), "ts", F.col("lags").alias("y_lags"))
    products = [lag("x_", 0) * lag("y_", h) for h in range(reach + 1)] + [lag("y_", 0) * lag("x_", h) for h in range(1, reach + 1)]
    both = _moments(x.join(y, "ts").where("n1 < n2"), ["n1", "n2"], products)
    for n in ("n1", "n2"):
        both = both.join(symbols.select(F.col("symbol").alias(n), F.col("m").alias(f"m_{n}"), F.col("ends").alias(f"e_{n}")), n)
    return both


class PairMoments:
    """Moments of one pair in one of the windows."""

    def __init__(self, row, window: Window, at: int, reach: int):
        self.reach = reach
        self.n, xy = self._upto(row.m, at)
        _, x = self._upto(row.m_n1, at)
        _, y = self._upto(row.m_n2, at)
        x_at, y_at = ({int(e["rn"]): e["v"] for e in ends} for ends in (row.e_n1, row.e_n2))
        get = lambda values, lo, hi, step=1: np.array([values.get(r, 0.0) for r in range(lo, hi, step)])
        a, b, k = window.start_rn, window.end_rn, reach
        self.x_head, self.y_head = get(x_at, a, a + k + 1), get(y_at, a, a + k + 1)
        self.x_tail, self.y_tail = get(x_at, b, b - k - 1, -1), get(y_at, b, b - k - 1, -1)
        x_old, y_old = get(x_at, a - k, a), get(y_at, a - k, a)
        self.x_total, self.y_total = x[0], y[0]
        self.xx, self.yy = self._cut(x[1:], self.x_head, x_old), self._cut(y[1:], self.y_head, y_old)
        self.xy = self._cut(xy[:k + 1], self.x_head, y_old)
        self.yx = self._cut(np.append(xy[0], xy[k + 1:]), self.y_head, x_old)

    @staticmethod
    def _upto(parts, at: int) -> tuple[int, np.ndarray]:
        """Sums of the slices that make up a window."""
        held = [p for p in parts if p["slice"] <= at]
        return sum(int(p["n"]) for p in held), np.sum([np.asarray(p["sums"], dtype=float) for p in held], axis=0)

    @staticmethod
    def _cut(s: np.ndarray, head: np.ndarray, old: np.ndarray) -> np.ndarray:
        """Without the products that reach back to before the window."""
        k = len(old)
        return np.array([s[h] - sum(head[t] * old[k + t - h] for t in range(min(h, len(head)))) for h in range(len(s))])

    def leg(self, side: str) -> Lagged:
        return Lagged(getattr(self, side * 2), getattr(self, f"{side}_total"), getattr(self, f"{side}_head"), getattr(self, f"{side}_tail"), self.n)

    def centred(self) -> tuple[float, float, float]:
        """Centred sums of squares and products."""
        n = self.n
        return (self.xx[0] - self.x_total ** 2 / n, self.yy[0] - self.y_total ** 2 / n, self.xy[0] - self.x_total * self.y_total / n)

    def corr(self) -> float:
        cxx, cyy, cxy = self.centred()
        return cxy / math.sqrt(cxx * cyy) if self.n > 2 and cxx > 0 and cyy > 0 else math.nan

    def residual(self) -> Lagged | None:
        """x - b*y - a; None where the legs are collinear."""
        cxx, cyy, cxy = self.centred()
        b = cxy / cyy if cyy > 0 else 0.0
        a = (self.x_total - b * self.y_total) / self.n
        if cxx - b * cxy <= 100 * math.sqrt(np.finfo(float).eps) * cxx:
            return None
        mix = lambda x, y: x - b * y
        head, tail = mix(self.x_head, self.y_head), mix(self.x_tail, self.y_tail)
        h = np.arange(self.reach + 1)
        total = mix(self.x_total, self.y_total)
        late = total - np.concatenate([[0.0], np.cumsum(head)])[h]    # sum over t >= h
        early = total - np.concatenate([[0.0], np.cumsum(tail)])[h]   # sum over t <= n-1-h
        s = self.xx - b * (self.xy + self.yx) + b * b * self.yy - a * (late + early) + a * a * (self.n - h)
        return Lagged(s, 0.0, head - a, tail - a, self.n)

    def coint_p(self) -> float:
        """Engle-Granger p value of x on y and a constant."""
        if self.n < 10:
            return math.nan
        e = self.residual()
        return 0.0 if e is None else mackinnon_p(adf_t_of(e, False), 2)

    def coint_t(self, lag: int) -> float:
        e = self.residual() if self.n >= 2 * lag + 10 else None
        return math.nan if e is None else t_at(e, lag, False)

    def stationary_p(self, side: str) -> float:
        leg = self.leg(side)
        if leg.s[0] - leg.total ** 2 / leg.n <= 0:
            return math.nan
        return mackinnon_p(adf_t_of(leg, True), 1)


def horizon_windows(panel: DataFrame, days: Sequence[int] | None) -> list[Window]:
    """Trailing windows of ``days``, the shortest first (None: the whole panel).  A few numbers come to the driver."""
    from tandem.operators.regression import horizon_starts
    if days is None:
        r = panel.agg(F.min("rn").alias("a"), F.max("rn").alias("b")).first()
        return [] if r.a is None else [Window("all", r.a, r.b)]
    rows = horizon_starts(panel, days).collect()
    return sorted((Window(str(r.days), r.start_rn, r.end_rn) for r in rows if r.start_rn is not None), key=lambda w: w.n)


def reach_of(windows: Sequence[Window]) -> int:
    return max([max(0, top_lag(w.n, False)) for w in windows], default=0) + 1


def test_windows(panel: DataFrame, windows: list[Window], schema: str, finish, reach: int | None = None) -> DataFrame:
    """``finish(n1, n2, [PairMoments of each window])`` gives a row of ``schema`` for every pair."""
    reach = reach or reach_of(windows)
    names = [f.split()[0] for f in schema.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [finish(r.n1, r.n2, [PairMoments(r, w, k, reach) for k, w in enumerate(windows)]) for r in batch.itertuples(index=False)]
            yield pd.DataFrame(out, columns=names)

    return pair_moments(panel, windows, reach).mapInPandas(rows, schema)


def pearson(m: PairMoments) -> tuple[float, float]:
    r = m.corr()
    return r, pearson_p(r, m.n)
