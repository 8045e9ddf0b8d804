"""Window features and volatility queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tandem.operators import features as ft, volatility as vol
from tandem.operators.pairs import all_pair_bars
from tandem.plans import feeds
from tandem.plans.feeds import bars_sql, panel_sql, with_
from tandem.plans.registry import query

W = "OVER (PARTITION BY symbol ORDER BY rn)"


@query("w01_log_return", with_(bars_sql(), f"""
, r AS (SELECT symbol, ts, rn, ln(m / lag(m) {W}) AS r FROM (SELECT *, (open + high + low + close) / 4 AS m FROM bars))
SELECT symbol, ts, round(r, 9) AS r, round(sum(r) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING), 9) + 0 AS cum FROM r WHERE rn > 0"""))
def _(spark, sf):
    d = ft.log_return(feeds.bars(spark, sf), ft.ohlc4()).where("rn > 0")
    d = ft.cumulative(d, "r", "cum", 500)
    return d.select("symbol", "ts", F.round("r", 9).alias("r"), F.round("cum", 9).alias("cum"))


@query("w02_fwd_return", with_(bars_sql(), f"SELECT symbol, ts, round(lead(close) {W} / close, 9) AS r FROM bars"))
def _(spark, sf):
    return ft.fwd_return(feeds.bars(spark, sf), F.col("close")).select("symbol", "ts", F.round("r", 9).alias("r"))


@query("w03_sma", with_(bars_sql(), "SELECT symbol, ts, " + ", ".join(
    f"round(CASE WHEN rn >= {n - 1} THEN avg(close) OVER (PARTITION BY symbol ORDER BY rn ROWS {n - 1} PRECEDING) END, 9) AS sma_{n}"
    for n in (5, 10, 14, 15, 20)) + " FROM bars"))
def _(spark, sf):
    d = ft.sma(feeds.bars(spark, sf), [5, 10, 14, 15, 20])
    return d.select("symbol", "ts", *[F.round(f"sma_{n}", 9).alias(f"sma_{n}") for n in (5, 10, 14, 15, 20)])


@query("w04_ema", "WITH RECURSIVE " + bars_sql().strip() + """,
seed AS (SELECT symbol, avg(close) AS e FROM bars WHERE rn < 14 GROUP BY symbol),
e AS (SELECT symbol, CAST(13 AS BIGINT) AS rn, e FROM seed
  UNION ALL SELECT b.symbol, b.rn, b.close * (2e0 / 15) + e.e * (1 - 2e0 / 15) FROM e JOIN bars b ON b.symbol = e.symbol AND b.rn = e.rn + 1)
SELECT b.symbol, b.ts, round(e.e, 6) AS ema FROM bars b LEFT JOIN e ON e.symbol = b.symbol AND e.rn = b.rn""")
def _(spark, sf):
    return ft.ema(feeds.bars(spark, sf), 14).select("symbol", "ts", F.round("ema", 6).alias("ema"))


@query("w04_atr", "WITH RECURSIVE " + bars_sql().strip() + f""",
p AS (SELECT *, lag(close) {W} AS pc FROM bars),
tr AS (SELECT symbol, ts, rn, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM p WHERE rn >= 1),
seed AS (SELECT symbol, avg(tr) AS a FROM tr WHERE rn BETWEEN 1 AND 14 GROUP BY symbol),
a AS (SELECT symbol, CAST(14 AS BIGINT) AS rn, a FROM seed
  UNION ALL SELECT t.symbol, t.rn, (a.a * 13 + t.tr) / 14 FROM a JOIN tr t ON t.symbol = a.symbol AND t.rn = a.rn + 1),
m AS (SELECT symbol, rn, ts, avg(close) OVER (PARTITION BY symbol ORDER BY rn ROWS 13 PRECEDING) AS ma FROM bars)
SELECT m.symbol, m.ts, round(a.a, 6) AS atr, round(100 * a.a / ma, 6) AS atr_pct FROM m LEFT JOIN a ON a.symbol = m.symbol AND a.rn = m.rn""")
def _(spark, sf):
    d = ft.sma(ft.atr(feeds.bars(spark, sf), 14), [14])
    return d.select("symbol", "ts", F.round("atr", 6).alias("atr"), F.round(100 * F.col("atr") / F.col("sma_14"), 6).alias("atr_pct"))


@query("w05_rolling_std", with_(bars_sql(), """
SELECT symbol, ts, round(CASE WHEN rn >= 19 THEN stddev_samp(close) OVER w END, 6) AS std_samp,
  round(CASE WHEN rn >= 19 THEN stddev_pop(close) OVER w END, 6) AS std_pop
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS 19 PRECEDING)"""))
def _(spark, sf):
    d = ft.rolling_std(feeds.bars(spark, sf), 20)
    return d.select("symbol", "ts", F.round("std_samp", 6).alias("std_samp"), F.round("std_pop", 6).alias("std_pop"))


PAIR_ROWS_SQL = panel_sql() + """,
pr AS (SELECT a.symbol AS n1, b.symbol AS n2, a.ts, a.rn, a.close AS x, b.close AS y FROM panel a JOIN panel b
  ON a.ts = b.ts AND a.symbol < b.symbol)"""


def pair_rows(spark, sf):
    both = all_pair_bars(feeds.panel(spark, sf), ["close", "rn"])
    return both.withColumnRenamed("x_rn", "rn").drop("y_rn")


@query("w06_rolling_corr", with_(PAIR_ROWS_SQL, """
SELECT n1, n2, ts, round(CASE WHEN rn >= 59 THEN corr(x, y) OVER (PARTITION BY n1, n2 ORDER BY rn ROWS BETWEEN 59 PRECEDING AND 1 PRECEDING) END, 6) AS corr
FROM pr"""))
def _(spark, sf):
    return ft.rolling_corr(pair_rows(spark, sf), 60).select("n1", "n2", "ts", F.round("corr", 6).alias("corr"))


REGR_SQL = PAIR_ROWS_SQL + """,
reg AS (SELECT *, CASE WHEN rn >= 99 THEN regr_slope(y, x) OVER w END AS slope,
  CASE WHEN rn >= 99 THEN regr_intercept(y, x) OVER w END AS intercept FROM pr
  WINDOW w AS (PARTITION BY n1, n2 ORDER BY rn ROWS BETWEEN 779 PRECEDING AND 1 PRECEDING))"""


@query("w07_rolling_linreg", with_(REGR_SQL, """
SELECT n1, n2, ts, round(slope, 6) AS slope, round(intercept, 3) AS intercept, round(intercept + slope * x - y, 5) AS diff FROM reg"""))
def _(spark, sf):
    d = ft.rolling_linreg(pair_rows(spark, sf))
    return d.select("n1", "n2", "ts", F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"),
                    F.round("diff", 5).alias("diff"))


@query("w07_linreg_summary", with_(REGR_SQL, """
, d AS (SELECT *, intercept + slope * x - y AS diff FROM reg),
s AS (SELECT n1, n2, avg(diff) AS m, stddev_samp(diff) AS std, arg_max(diff, rn) AS d, arg_max(slope, rn) AS slope FROM d GROUP BY 1, 2)
SELECT n1, n2, round(m, 5) AS m, round(std, 5) AS std, round(slope, 5) AS slope, round((d - m) / std, 4) AS z,
  CASE WHEN d > m + 2 * std THEN 1 WHEN d < m - 2 * std THEN -1 ELSE 0 END AS side FROM s"""))
def _(spark, sf):
    d = ft.linreg_summary(ft.rolling_linreg(pair_rows(spark, sf)))
    return d.select("n1", "n2", F.round("m", 5).alias("m"), F.round("std", 5).alias("std"),
                    F.round("slope", 5).alias("slope"), F.round("z", 4).alias("z"), "side")


def _vol_sql(windows: dict[str, int], scale: float) -> str:
    """CTE ``vol`` with one column per estimator and window, written as plain frames."""
    cols = []
    for label, w in windows.items():
        n = w - 1
        full = f"OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {w - 1} PRECEDING AND 1 PRECEDING)"
        less = f"OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {w - 2} PRECEDING AND 1 PRECEDING)"
        k = 0.34 / (1.34 + (n + 1) / (n - 1))
        s0 = (1 - 0.94 ** n) / 0.06
        sw2 = (1 - 0.94 ** (2 * n)) / (1 - 0.94 ** 2)
        ready = f"CASE WHEN rn >= {w - 1} THEN {scale!r} * "
        cols += [
            f"{ready} sqrt(sum(hl2) {full} / (4 * {n} * ln(2))) END AS parkinson_{label}",
            f"{ready} sqrt(greatest(sum(hl2) {full} / 2 / {n} - (2 * ln(2) - 1) * sum(cc * cc) {less} / {n}, 0)) END AS garman_klass_{label}",
            f"{ready} sqrt(greatest(var_samp(oo) {less} + {k!r} * var_samp(cc) {less} + (1 - {k!r}) * sum(rs) {full} / {n}, 0)) END AS yang_zhang_{label}",
            f"{ready} sqrt(greatest(list_sum(list_transform(list(co) {full}, lambda v, i: v * v * pow(0.94e0, {n} - i))) / {s0!r}"
            f" - pow(list_sum(list_transform(list(co) {full}, lambda v, i: v * pow(0.94e0, {n} - i))) / {s0!r}, 2), 0)"
            f" * {s0 * s0 / (s0 * s0 - sw2)!r}) END AS ewma_{label}"]
    return f""",
v0 AS (SELECT *, pow(ln(high / low), 2) AS hl2, ln(close / lag(close) {W}) AS cc, ln(open / lag(open) {W}) AS oo,
  ln(close / open) AS co, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs FROM panel),
vol AS (SELECT symbol, ts, rn, {', '.join(cols)} FROM v0)"""


SCALE_10M = math.sqrt(252 * 6.5 * 6)


def _one_vol(name, estimator):
    @query(name, with_(panel_sql() + _vol_sql({"w": 60}, SCALE_10M), f"""
SELECT symbol, ts, round({estimator}_w, 6) AS sigma FROM vol"""))
    def _(spark, sf):
        d = vol.rolling_volatility(feeds.panel(spark, sf), {"w": 60}, SCALE_10M, [estimator])
        return d.select("symbol", "ts", F.round(f"{estimator}_w", 6).alias("sigma"))


for _name, _est in (("w08_hv_parkinson", "parkinson"), ("w09_hv_garman_klass", "garman_klass"),
                    ("w10_hv_yang_zhang", "yang_zhang"), ("w11_hv_ewma", "ewma")):
    _one_vol(_name, _est)


@query("w12_annualize", """
WITH m(interval, bars) AS (VALUES ('1h', 1), ('30m', 2), ('15m', 4), ('5m', 12), ('3m', 20), ('1m', 60)),
e AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN '1d' WHEN 1 THEN '1h' WHEN 2 THEN '30m' WHEN 3 THEN '15m'
  WHEN 4 THEN '5m' WHEN 5 THEN '3m' ELSE '1m' END AS interval, CASE WHEN user_id % 2 = 0 THEN 6.5e0 ELSE 5.5e0 END AS hrs, value FROM events)
SELECT event_id, e.interval, round(value * sqrt(252 * CASE WHEN e.interval = '1d' THEN 1 ELSE hrs * bars END), 6) AS yearly
FROM e LEFT JOIN m ON m.interval = e.interval""")
def _(spark, sf):
    e = feeds.table(spark, sf, "events")
    names = F.array(*[F.lit(i) for i in ("1d", "1h", "30m", "15m", "5m", "3m", "1m")])
    d = e.withColumn("interval", F.element_at(names, (F.col("event_id") % 7 + 1).cast("int")))
    market = F.when(F.col("user_id") % 2 == 0, "us").otherwise("hk")
    return d.select("event_id", "interval", F.round(F.col("value") * vol.annualize(F.col("interval"), market), 6).alias("yearly"))


@query("e12_bars_per_day", """
SELECT user_id, CASE user_id % 4 WHEN 0 THEN 6.5e0 WHEN 1 THEN 78e0 WHEN 2 THEN 390e0 ELSE 1e0 END AS bars_per_day, count(*) AS n FROM events GROUP BY 1, 2""")
def _(spark, sf):
    e = feeds.table(spark, sf, "events")
    names = F.array(*[F.lit(i) for i in ("1h", "5m", "1m", "1d")])
    iv = F.element_at(names, (F.col("user_id") % 4 + 1).cast("int"))
    return (e.groupBy("user_id", vol.bars_per_day_column(iv, F.lit("us")).alias("bars_per_day"))
            .agg(F.count(F.lit(1)).alias("n")))


# Cone windows in 10-minute bars of a 6.5 h day; longer horizons than the data give no rows.
CONE = {f"{d}d": int(6.5 * 6 * d) for d in vol.CONE_DAYS}
EST = ["parkinson", "garman_klass", "yang_zhang", "ewma"]


def _cone_long_sql():
    cols = ", ".join(f"{e}_{h}" for e in EST for h in CONE)
    return panel_sql() + _vol_sql(CONE, SCALE_10M) + f""",
long AS (SELECT symbol, rn, regexp_extract(name, '^(.*)_[^_]+$', 1) AS estimator, regexp_extract(name, '_([^_]+)$', 1) AS horizon, sigma
  FROM (UNPIVOT (SELECT * EXCLUDE (ts) FROM vol) ON {cols} INTO NAME name VALUE sigma))"""


def cone_long(spark, sf):
    """Read several times by the quantile steps, so it is written once."""
    def build():
        wide = vol.rolling_volatility(feeds.panel(spark, sf), CONE, SCALE_10M, EST)
        return vol.volatility_long(wide, CONE, EST)
    return feeds.stored(spark, sf, "cone", build)


@query("w13_vol_cone", with_(_cone_long_sql(), """
SELECT symbol, estimator, horizon, count(*) AS "count", round(avg(sigma), 6) AS mean, round(stddev_samp(sigma), 5) AS std, round(min(sigma), 5) AS min,
  round(quantile_cont(sigma, 0.25), 5) AS p25, round(quantile_cont(sigma, 0.5), 5) AS p50, round(quantile_cont(sigma, 0.75), 5) AS p75,
  round(max(sigma), 5) AS max FROM long GROUP BY 1, 2, 3"""))
def _(spark, sf):
    d = vol.vol_cone(cone_long(spark, sf))
    return d.select("symbol", "estimator", "horizon", "count", F.round("mean", 6).alias("mean"),
                    *[F.round(c, 5).alias(c) for c in ("std", "min", "p25", "p50", "p75", "max")])


_GRID = ", ".join(str(q) for q in vol.RANK_GRID)


@query("w14_vol_cone_rank", with_(_cone_long_sql(), f"""
, g AS (SELECT symbol, estimator, horizon, arg_max(sigma, rn) AS sigma, quantile_cont(sigma, [{_GRID}]) AS q FROM long GROUP BY 1, 2, 3),
u AS (SELECT symbol, estimator, horizon, sigma, unnest([{_GRID}]) AS q, unnest(q) AS v FROM g)
SELECT symbol, estimator, horizon, round(any_value(sigma), 5) AS sigma, CAST(arg_min(q, ROW(abs(v - sigma), q)) AS DOUBLE) AS q FROM u GROUP BY 1, 2, 3"""))
def _(spark, sf):
    d = vol.vol_cone_rank(cone_long(spark, sf))
    return d.select("symbol", "estimator", "horizon", F.round("sigma", 5).alias("sigma"), "q")


@query("w15_quantile_rank_series", f"""
WITH g AS (SELECT event_type, quantile_cont(value, [{_GRID}]) AS q FROM events GROUP BY 1),
u AS (SELECT event_type, unnest([{_GRID}]) AS q, unnest(q) AS v FROM g)
SELECT e.event_id, e.value, CAST(arg_min(u.q, ROW(abs(u.v - e.value), u.q)) AS DOUBLE) AS q FROM events e JOIN u ON e.event_type = u.event_type GROUP BY 1, 2""")
def _(spark, sf):
    e = feeds.table(spark, sf, "events").select("event_id", "event_type", "value")
    return vol.quantile_rank_series(e, ["event_type"], "value").select("event_id", "value", "q")


@query("w26_sma_cross_signal", with_(bars_sql(), """
, m AS (SELECT *, CASE WHEN rn >= 4 THEN avg(close) OVER (PARTITION BY symbol ORDER BY rn ROWS 4 PRECEDING) END AS f,
  CASE WHEN rn >= 14 THEN avg(close) OVER (PARTITION BY symbol ORDER BY rn ROWS 14 PRECEDING) END AS s FROM bars)
SELECT symbol, ts, CASE WHEN close > f AND f > s THEN 1 WHEN close < f AND f < s THEN -1 ELSE 0 END AS signal FROM m"""))
def _(spark, sf):
    return ft.sma_cross_signal(feeds.bars(spark, sf)).select("symbol", "ts", "signal")
