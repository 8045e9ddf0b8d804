"""Aggregations, correlations and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.operators import aggregates as agg, clean
from tandem.operators.features import log_return, ohlc4
from tandem.plans import feeds
from tandem.plans.feeds import bars_sql, panel_sql, with_
from tandem.plans.registry import query


@query("a02_day_extreme_times", with_(bars_sql(), """
, e AS (SELECT symbol, CAST(ts AS DATE) AS day, max(high) AS h, min(low) AS l FROM bars GROUP BY 1, 2)
SELECT b.symbol, CAST(e.day AS VARCHAR) AS day,
  CAST(min(hour(ts) * 60 + minute(ts)) FILTER (abs(high - h) <= 1e-8 + 1e-5 * abs(h)) AS BIGINT) AS high_minute,
  CAST(min(hour(ts) * 60 + minute(ts)) FILTER (abs(low - l) <= 1e-8 + 1e-5 * abs(l)) AS BIGINT) AS low_minute
FROM bars b JOIN e ON e.symbol = b.symbol AND e.day = CAST(b.ts AS DATE) GROUP BY 1, 2"""))
def _(spark, sf):
    d = agg.day_extreme_times(feeds.bars(spark, sf))
    return d.select("symbol", F.col("day").cast("string").alias("day"), F.col("high_minute").cast("bigint").alias("high_minute"),
                    F.col("low_minute").cast("bigint").alias("low_minute"))


@query("a02_extreme_histogram", with_(bars_sql(), """
, e AS (SELECT symbol, CAST(ts AS DATE) AS day, max(high) AS h, min(low) AS l FROM bars GROUP BY 1, 2),
t AS (SELECT b.symbol, e.day, min(hour(ts) * 60 + minute(ts)) FILTER (abs(high - h) <= 1e-8 + 1e-5 * abs(h)) AS hm,
  min(hour(ts) * 60 + minute(ts)) FILTER (abs(low - l) <= 1e-8 + 1e-5 * abs(l)) AS lm
  FROM bars b JOIN e ON e.symbol = b.symbol AND e.day = CAST(b.ts AS DATE) GROUP BY 1, 2)
SELECT symbol, extreme, CAST(m // 60 * 60 AS BIGINT) AS minute_bin, count(*) AS days FROM
 (SELECT symbol, 'H' AS extreme, hm AS m FROM t UNION ALL SELECT symbol, 'L', lm FROM t) GROUP BY 1, 2, 3"""))
def _(spark, sf):
    return agg.minute_histogram(agg.day_extreme_times(feeds.bars(spark, sf)), 60)


@query("a03_price_histogram", with_(bars_sql(), """
, p AS (SELECT symbol, round((open + high + low + close) / 4, 3) AS p FROM bars),
s AS (SELECT symbol, min(p) AS lo, max(p) AS hi FROM p GROUP BY 1)
SELECT p.symbol, CAST(coalesce(least(floor((p - lo) / (hi - lo) * 100), 99), 0) AS BIGINT) AS bin, count(*) AS n
FROM p JOIN s ON p.symbol = s.symbol GROUP BY 1, 2"""))
def _(spark, sf):
    return agg.price_histogram(feeds.bars(spark, sf))


@query("a04_describe_series", """
SELECT event_type, count(value) AS "count", round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min,
  round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS max FROM events GROUP BY 1""")
def _(spark, sf):
    d = agg.describe_series(feeds.table(spark, sf, "events"), ["event_type"], "value")
    return d.select("event_type", "count", "min", "max",
                    *[F.round(c, 6).alias(c) for c in ("mean", "std", "p25", "p50", "p75")])


@query("a07_corr_matrix", with_(panel_sql(), """
, r AS (SELECT symbol, ts, coalesce(ln(m / lag(m) OVER (PARTITION BY symbol ORDER BY ts)), 0) AS r
  FROM (SELECT *, (open + high + low + close) / 4 AS m FROM panel))
SELECT a.symbol AS a, b.symbol AS b, round(corr(a.r, b.r), 6) AS corr FROM r a JOIN r b ON a.ts = b.ts GROUP BY 1, 2"""))
def _(spark, sf):
    c = agg.corr_matrix(panel_returns(spark, sf))
    return c.select("a", "b", F.round("corr", 6).alias("corr"))


def panel_returns(spark, sf):
    d = log_return(feeds.panel(spark, sf), ohlc4())
    return d.select("symbol", "ts", "rn", clean.clean_returns("r").alias("r"))


def _lag_sql():
    leads = ", ".join(f"lead(r, {6 * k}) OVER (PARTITION BY symbol ORDER BY ts) AS f{k}" for k in range(1, 8))
    return panel_sql() + f""",
r AS (SELECT symbol, ts, rn, ln(m / lag(m) OVER (PARTITION BY symbol ORDER BY ts)) AS r
  FROM (SELECT *, (open + high + low + close) / 4 AS m FROM panel)),
r1 AS (SELECT symbol, ts, r, {leads} FROM r WHERE rn > 0),
f AS (UNPIVOT r1 ON f1, f2, f3, f4, f5, f6, f7 INTO NAME kname VALUE f),
lagcorr AS (SELECT f.symbol AS a, c.symbol AS c, CAST(substr(kname, 2) AS INTEGER) AS k, corr(f.f, c.r) AS corr
  FROM f JOIN r1 c ON f.ts = c.ts GROUP BY 1, 2, 3)"""


def _lagged(spark, sf):
    r = panel_returns(spark, sf).where("rn > 0")
    return agg.lagged_corr(r, 6, range(1, 8))


@query("a08_lagged_corr", with_(_lag_sql(), "SELECT a, c, k, round(corr, 6) AS corr FROM lagcorr"))
def _(spark, sf):
    return _lagged(spark, sf).select("a", "c", "k", F.round("corr", 6).alias("corr"))


@query("t02_top_n_correlated", with_(_lag_sql(), """
SELECT c, a, k, round(corr, 6) AS corr, row_number() OVER (PARTITION BY c ORDER BY abs(corr) DESC, a, k) AS rank FROM lagcorr
QUALIFY rank <= 10"""))
def _(spark, sf):
    top = agg.top_n_correlated(_lagged(spark, sf), "c", ["a", "k"], 10)
    return top.select("c", "a", "k", F.round("corr", 6).alias("corr"), F.col("rank").cast("bigint").alias("rank"))


@query("t02_least_correlated_json", with_(panel_sql(), """
, r AS (SELECT symbol, ts, coalesce(ln(m / lag(m) OVER (PARTITION BY symbol ORDER BY ts)), 0) AS r
  FROM (SELECT *, (open + high + low + close) / 4 AS m FROM panel)),
c AS (SELECT a.symbol AS a, b.symbol AS b, corr(a.r, b.r) AS corr FROM r a JOIN r b ON a.ts = b.ts GROUP BY 1, 2),
t AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY abs(corr), b) AS k FROM c QUALIFY k <= 3)
SELECT a, '["' || string_agg(b, '","' ORDER BY k) || '"]' AS top FROM t GROUP BY a"""))
def _(spark, sf):
    c = agg.corr_matrix(panel_returns(spark, sf))
    return agg.top_n_json(agg.top_n_correlated(c, "a", ["b"], 3, least=True), "a", ["b"])


@query("a27_call_rate_audit", """
WITH c AS (SELECT event_id, event_type AS call_name, user_id AS symbol, epoch_us(ts) AS us FROM events),
n AS (SELECT event_id,
  count(*) OVER (ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) - 1 AS calls_total,
  count(*) OVER (PARTITION BY call_name ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) - 1 AS calls_same,
  count(*) OVER (PARTITION BY call_name, symbol ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) - 1 AS calls_same_symbol
  FROM c)
SELECT *, calls_total < 340 AND calls_same < 4 AND calls_same_symbol < 2 AS allowed FROM n""")
def _(spark, sf):
    e = feeds.table(spark, sf, "events")
    calls = e.select("event_id", F.col("event_type").alias("call_name"), F.col("user_id").alias("symbol"), "ts")
    d = agg.call_rate_audit(calls, 86_400, 340, 3600, 4, 86_400, 2)
    return d.select("event_id", "calls_total", "calls_same", "calls_same_symbol", "allowed")


@query("a27_call_rate_audit_default_limits", """
WITH c AS (SELECT event_id, event_type AS call_name, user_id AS symbol, epoch_us(ts) AS us FROM events),
n AS (SELECT event_id,
  count(*) OVER (ORDER BY us RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW) - 1 AS t,
  count(*) OVER (PARTITION BY call_name ORDER BY us RANGE BETWEEN 1000000 PRECEDING AND CURRENT ROW) - 1 AS s,
  count(*) OVER (PARTITION BY call_name, symbol ORDER BY us RANGE BETWEEN 2000000 PRECEDING AND CURRENT ROW) - 1 AS p FROM c)
SELECT event_id, t < 60 AND s < 1 AND p < 6 AS allowed FROM n""")
def _(spark, sf):
    e = feeds.table(spark, sf, "events")
    calls = e.select("event_id", F.col("event_type").alias("call_name"), F.col("user_id").alias("symbol"), "ts")
    return agg.call_rate_audit(calls).select("event_id", "allowed")
