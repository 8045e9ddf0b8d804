"""Bars, cleaning and slicing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.operators import asof, clean, pairs, resample
from tandem.plans import feeds
from tandem.plans.feeds import HORIZONS, PRICE_COLS, bars_sql, panel_sql, with_
from tandem.plans.registry import query


def _ohlc(df, *extra):
    return df.select("symbol", "ts", "open", "high", "low", "close", "volume", F.round("wap", 6).alias("wap"), *extra)


@query("a01_resample_ohlcv", with_(bars_sql("1 hour"), "SELECT symbol, ts, open, high, low, close, volume, wap FROM bars"))
def _(spark, sf):
    return resample.resample_ticks(feeds.price_path(spark, sf), "1 hour", units="units")


@query("a01_resample_bars_to_bars", with_(bars_sql(), """
SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, ts) AS close, sum(volume) AS volume,
  round(sum(wap * volume) / nullif(sum(CASE WHEN wap IS NOT NULL THEN volume END), 0), 6) AS wap
FROM bars GROUP BY 1, 2"""))
def _(spark, sf):
    return _ohlc(resample.resample_bars(feeds.bars(spark, sf), "1 hour"))


@query("a01_fill_empty_bins", with_(bars_sql("1 hour"), """
, span AS (SELECT symbol, min(ts) a, max(ts) z FROM bars GROUP BY 1),
grid AS (SELECT symbol, unnest(generate_series(a, z, INTERVAL '1 hour')) AS ts FROM span)
SELECT g.symbol, g.ts, b.close, b.volume FROM grid g LEFT JOIN bars b ON g.symbol = b.symbol AND g.ts = b.ts"""))
def _(spark, sf):
    b = feeds.bars(spark, sf, "1 hour").select("symbol", "ts", "close", "volume")
    return resample.fill_empty_bins(b, 3600)


@query("p01_long_to_wide", with_(bars_sql("1 hour"), """
SELECT ts, """ + ", ".join(f"max({f}) FILTER (symbol = '{s}') AS {f}_{s}" for s in
                           ("click", "error", "purchase", "signup", "view") for f in ("close", "volume")) + """
FROM bars GROUP BY ts"""))
def _(spark, sf):
    b = feeds.bars(spark, sf, "1 hour")
    return clean.long_to_wide(b, asof.universe_list(b), ["close", "volume"])


@query("p01_wide_to_long", with_(bars_sql("1 hour"), """
SELECT s.symbol, t.ts, b.close, b.volume FROM (SELECT DISTINCT ts FROM bars) t CROSS JOIN (SELECT DISTINCT symbol FROM bars) s
LEFT JOIN bars b ON b.ts = t.ts AND b.symbol = s.symbol"""))
def _(spark, sf):
    b = feeds.bars(spark, sf, "1 hour")
    wide = clean.long_to_wide(b, asof.universe_list(b), ["close", "volume"])
    return clean.wide_to_long(wide, ["close", "volume"])


@query("p02_strip_tz", """
SELECT event_id, ts AS local_ts FROM events""")
def _(spark, sf):
    from tandem.functions.timeline import strip_tz
    e = feeds.table(spark, sf, "events")
    offset = F.element_at(F.array(F.lit("-05:00"), F.lit("+08:00"), F.lit("Z"), F.lit("-0400")),
                          (F.col("event_id") % 4 + 1).cast("int"))
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), offset)
    return e.select("event_id", strip_tz(text).alias("local_ts"))


@query("p03_drop_null_rows", with_(bars_sql(), """
SELECT symbol, ts, close FROM bars WHERE ts IN
  (SELECT ts FROM bars GROUP BY ts HAVING count(close) = (SELECT count(DISTINCT symbol) FROM bars))"""))
def _(spark, sf):
    b = feeds.bars(spark, sf).select("symbol", "ts", "close")
    return clean.drop_null_rows(b, asof.universe_list(b), ["close"])


@query("p04_drop_incomplete_symbols", with_(bars_sql("6 hours"), """
SELECT symbol, ts, close FROM bars WHERE symbol IN
  (SELECT symbol FROM bars GROUP BY symbol HAVING count(close) = (SELECT count(DISTINCT ts) FROM bars))"""))
def _(spark, sf):
    b = feeds.bars(spark, sf, "6 hours").select("symbol", "ts", "close")
    return clean.drop_incomplete_symbols(b, ["close"])


@query("p05_dedup_bars", with_(bars_sql("1 hour"), """
, again AS (SELECT symbol, ts, close, volume, 0 AS src FROM bars UNION ALL
  SELECT symbol, ts, close + 1, volume, 1 FROM bars WHERE volume > 50 UNION ALL
  SELECT symbol, ts + INTERVAL '30 minutes', close, volume, 2 FROM bars WHERE volume <= 50)
SELECT symbol, ts, close, volume FROM again QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY src) = 1"""))
def _(spark, sf):
    b = feeds.bars(spark, sf, "1 hour").select("symbol", "ts", "close", "volume")
    again = b.withColumn("src", F.lit(0)).unionByName(
        b.where("volume > 50").withColumn("close", F.col("close") + 1).withColumn("src", F.lit(1))).unionByName(
        b.where("volume <= 50").withColumn("ts", F.col("ts") + F.expr("INTERVAL 30 MINUTES")).withColumn("src", F.lit(2)))
    return clean.dedup_bars(again, "src").drop("src")


@query("p06_clean_returns", with_(bars_sql(), """
, r AS (SELECT symbol, ts, volume / nullif(lag(volume) OVER (PARTITION BY symbol ORDER BY ts), 0) AS g FROM bars)
SELECT symbol, ts, round(CASE WHEN g IS NULL OR isnan(g) OR isinf(g) THEN 0 ELSE g END, 8) AS growth FROM r"""))
def _(spark, sf):
    from tandem.operators.features import lagged
    d = lagged(feeds.bars(spark, sf), "volume", 1, "_prev")
    g = clean.clean_returns(F.try_divide(F.col("volume"), F.col("_prev")))
    return d.select("symbol", "ts", F.round(g, 8).alias("growth"))


@query("p07_slice_until", with_(bars_sql(), "SELECT symbol, ts, close FROM bars WHERE ts < TIMESTAMP '2024-01-16'"))
def _(spark, sf):
    return clean.slice_until(feeds.bars(spark, sf), "2024-01-15").select("symbol", "ts", "close")


@query("p08_trailing_days", with_(bars_sql(), """
SELECT symbol, ts, close FROM bars WHERE ts >= (SELECT max(ts) FROM bars) - INTERVAL '14 days'"""))
def _(spark, sf):
    return clean.trailing(feeds.bars(spark, sf), 14).select("symbol", "ts", "close")


@query("p08_tail_rows", with_(bars_sql(), """
SELECT symbol, ts, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 500"""))
def _(spark, sf):
    return clean.tail(feeds.bars(spark, sf), 500).select("symbol", "ts", "close")


@query("p09_assert_span", with_(bars_sql(), "SELECT symbol, count(*) AS bars FROM bars GROUP BY symbol"))
def _(spark, sf):
    return clean.assert_span(feeds.bars(spark, sf), 20).groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))


_DATES_SQL = """
, models AS (SELECT DISTINCT CAST(ts AS DATE) + 1 AS model_date FROM bars),
days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM bars)"""


def _model_dates(b):
    return b.select(F.date_add(F.to_date("ts"), 1).alias("model_date")).distinct()


@query("p10_test_window", with_(bars_sql(), _DATES_SQL + """
, ranked AS (SELECT model_date, day, row_number() OVER (PARTITION BY model_date ORDER BY day) AS k
  FROM models JOIN days ON day >= model_date)
SELECT CAST(model_date AS VARCHAR) AS model_date, symbol, ts, close FROM bars JOIN ranked ON k = 2 AND CAST(ts AS DATE) = day"""))
def _(spark, sf):
    b = feeds.bars(spark, sf)
    got = clean.test_window(b, _model_dates(b))
    return got.select(F.col("model_date").cast("string").alias("model_date"), "symbol", "ts", "close")


@query("p11_bt_range", with_(bars_sql(), _DATES_SQL + """
, s AS (SELECT model_date, (SELECT min(ts) FROM bars WHERE ts >= model_date + INTERVAL '86399 seconds') AS start_ts
  FROM models)
SELECT CAST(CAST(model_date AS DATE) AS VARCHAR) AS model_date, start_ts, start_ts + INTERVAL '35100 seconds' AS end_ts FROM s
WHERE start_ts IS NOT NULL"""))
def _(spark, sf):
    b = feeds.bars(spark, sf)
    return clean.bt_range(b, _model_dates(b)).withColumn("model_date", F.col("model_date").cast("string"))


@query("p12_infer_interval", with_(bars_sql(), """
, g AS (SELECT symbol, CAST(date_diff('second', lag(ts) OVER (PARTITION BY symbol ORDER BY ts), ts) AS BIGINT) AS gap FROM bars),
n AS (SELECT symbol, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1, 2)
SELECT symbol, arg_max(gap, ROW(n, -gap)) AS interval_secs FROM n GROUP BY 1"""))
def _(spark, sf):
    return resample.infer_interval(feeds.bars(spark, sf))


@query("p13_trading_dates", with_(bars_sql(), """
SELECT DISTINCT CAST(CAST(ts AS DATE) + 1 AS VARCHAR) AS model_date FROM bars
WHERE ts >= (SELECT min(ts) FROM bars) + INTERVAL '7 days'"""))
def _(spark, sf):
    return clean.trading_dates(feeds.bars(spark, sf), 7).select(F.col("model_date").cast("string").alias("model_date"))


_PAIR_SQL = """
, pairs AS (SELECT a.symbol || '_' || b.symbol AS pair, a.symbol AS n1, b.symbol AS n2 FROM
  (SELECT DISTINCT symbol FROM bars) a JOIN (SELECT DISTINCT symbol FROM bars) b ON a.symbol < b.symbol)"""


@query("p14_filter_pairs_include", with_(bars_sql("1 hour"), _PAIR_SQL + """
, inc AS (SELECT symbol FROM bars GROUP BY symbol HAVING sum(volume) > (SELECT sum(volume) / 5.5 FROM bars))
SELECT pair FROM pairs WHERE n1 IN (SELECT symbol FROM inc) AND n2 IN (SELECT symbol FROM inc)"""))
def _(spark, sf):
    b = feeds.bars(spark, sf, "1 hour")
    share = b.agg(F.sum("volume") / 5.5)
    inc = b.groupBy("symbol").agg(F.sum("volume").alias("_v")).where(F.col("_v") > share.scalar())
    return clean.filter_pairs(pairs.enumerate_pairs(b), include=inc, available=b).select("pair")


@query("p14_filter_pairs_exclude", with_(bars_sql("1 hour"), _PAIR_SQL + """
, exc AS (SELECT arg_max(symbol, close) AS symbol FROM bars)
SELECT pair FROM pairs WHERE n1 NOT IN (SELECT symbol FROM exc) AND n2 NOT IN (SELECT symbol FROM exc)"""))
def _(spark, sf):
    b = feeds.bars(spark, sf, "1 hour")
    exc = b.agg(F.max_by("symbol", "close").alias("symbol"))
    return clean.filter_pairs(pairs.enumerate_pairs(b), exclude=exc, available=b).select("pair")


_QUOTE_FEED_SQL = """
, snaps AS (SELECT event_id, symbol, price - value AS BID, price AS ASK, price - value / 2 AS LAST
  FROM path JOIN (SELECT event_id, value FROM events) USING (event_id))"""


def _snaps(spark, sf):
    e = feeds.table(spark, sf, "events").select("event_id", "value")
    return feeds.price_path(spark, sf).join(e, "event_id").select(
        "event_id", "symbol", (F.col("price") - F.col("value")).alias("BID"), F.col("price").alias("ASK"),
        (F.col("price") - F.col("value") / 2).alias("LAST"))


@query("p19_valid_snapshots", with_(feeds.PATH_SQL, _QUOTE_FEED_SQL + """
SELECT event_id, symbol FROM snaps WHERE BID > 3 AND ASK > 3 AND LAST > 3 AND abs(BID - ASK) / ASK <= 0.05"""))
def _(spark, sf):
    return clean.valid_snapshots(_snaps(spark, sf), max_spread=0.05).select("event_id", "symbol")


_INSIDER_SQL = """
raw AS (SELECT o_orderkey, o_orderpriority AS ticker, o_totalprice AS value, o_totalprice / 1000 AS cost,
  o_orderdate AS dt FROM orders)"""


def raw_insiders(spark, sf):
    """Orders dressed as the vendor's text rows: thousands separators and month names."""
    o = feeds.table(spark, sf, "orders")
    return o.select("o_orderkey", F.col("o_orderpriority").alias("ticker"),
                    F.concat(F.lit(" "), F.format_number("o_totalprice", 2)).alias("value_text"),
                    F.concat(F.lit("$"), F.format_number(F.col("o_totalprice") / 1000, 5)).alias("cost_text"),
                    F.date_format("o_orderdate", "MMM dd yyyy").alias("date_text"),
                    F.date_format("o_orderdate", "MMM dd hh:mm a yyyy").alias("sec_text"))


def insiders(spark, sf):
    r = raw_insiders(spark, sf)
    return r.select("o_orderkey", "ticker", clean.parse_money("value_text").alias("value"),
                    F.round(clean.parse_money("cost_text"), 5).alias("cost"),
                    clean.parse_date("date_text", "MMM dd yyyy").alias("dt"),
                    clean.parse_date("sec_text", "MMM dd hh:mm a yyyy").alias("dt_sec"))


@query("p20_parse_money_dates", """
SELECT o_orderkey, o_orderpriority AS ticker, o_totalprice AS value, round(o_totalprice / 1000, 5) AS cost,
  o_orderdate AS dt, o_orderdate AS dt_sec FROM orders""")
def _(spark, sf):
    return insiders(spark, sf)


@query("p21_recent_insiders", with_(_INSIDER_SQL, """
SELECT o_orderkey, ticker, value, dt FROM raw WHERE dt >= TIMESTAMP '2001-08-01' - INTERVAL '90 days'
  AND value >= 150000 AND cost > 10"""))
def _(spark, sf):
    d = clean.recent_insiders(insiders(spark, sf), "2001-08-01", 90)
    return d.select("o_orderkey", "ticker", "value", "dt")


@query("p22_pair_split_arg", with_(bars_sql("1 hour"), _PAIR_SQL + """
SELECT pair, n1, n2, n1 || ' ' || n2 || ' -s 0.5 -m 0.25 --st 1.5 -i 10.0' AS arg FROM pairs"""))
def _(spark, sf):
    p = pairs.enumerate_pairs(feeds.bars(spark, sf, "1 hour")).select("pair")
    d = clean.pair_split(p).withColumns({"s": F.lit(0.5), "m": F.lit(0.25), "st": F.lit(1.5), "i": F.lit(10.0)})
    return d.select("pair", "n1", "n2", clean.pair_arg().alias("arg"))


@query("p23_adjust_prices", with_(bars_sql("1 hour"), """
, factors AS (SELECT symbol, date_trunc('week', ts) AS ex_ts, 1 - count(*) / 1e4 AS a, -count(*) / 1e2 AS b
  FROM bars GROUP BY 1, 2),
f2 AS (SELECT symbol, ex_ts, a, b, lag(ex_ts) OVER (PARTITION BY symbol ORDER BY ex_ts) AS from_ts FROM factors)
SELECT b.symbol, b.ts, round(b.close * coalesce(f.a, 1) + coalesce(f.b, 0), 6) AS adj_close FROM bars b LEFT JOIN f2 f
  ON f.symbol = b.symbol AND b.ts < f.ex_ts AND (f.from_ts IS NULL OR b.ts >= f.from_ts)"""))
def _(spark, sf):
    b = feeds.bars(spark, sf, "1 hour")
    week = F.date_trunc("week", F.col("ts")).cast("timestamp_ntz")
    f = b.groupBy("symbol", week.alias("ex_ts")).agg((1 - F.count(F.lit(1)) / 1e4).alias("a"),
                                                     (-F.count(F.lit(1)) / 1e2).alias("b"))
    got = clean.adjust_prices(b.select("symbol", "ts", "close"), f)
    return got.select("symbol", "ts", F.round("adj_close", 6).alias("adj_close"))
