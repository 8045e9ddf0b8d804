"""As-of, pair, watch-list and screening joins; set operations and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.operators import asof, clean, pairs
from tandem.plans import feeds
from tandem.plans.bars_plans import insiders
from tandem.plans.feeds import PRICE_COLS, bars_sql, panel_sql, with_
from tandem.plans.registry import query


@query("j01_asof_align", with_(panel_sql(), """
SELECT symbol, ts, close, volume FROM aligned"""))
def _(spark, sf):
    b = feeds.bars(spark, sf)
    symbols = asof.universe_list(b)
    return asof.asof_align(b, symbols, symbols[0], ["close", "volume"])


@query("j01_merged_panel", with_(panel_sql(), """
SELECT symbol, ts, close, volume, CAST(rn AS BIGINT) AS rn FROM panel"""))
def _(spark, sf):
    return feeds.panel(spark, sf).select("symbol", "ts", "close", "volume", "rn")


@query("j02_asof_join_ticks_bars", with_(bars_sql(), """
SELECT t.symbol, t.event_id, b.close AS bar_close, round((t.price - b.close) / b.close, 9) AS premium
FROM path t ASOF LEFT JOIN bars b ON t.symbol = b.symbol AND t.ts >= b.ts"""))
def _(spark, sf):
    t = feeds.price_path(spark, sf).select("symbol", "ts", "event_id", "price")
    got = asof.asof_join(t, feeds.bars(spark, sf), ["symbol"], ["close"], suffix="_bar")
    return got.select("symbol", "event_id", F.col("close_bar").alias("bar_close"),
                      F.round((F.col("price") - F.col("close_bar")) / F.col("close_bar"), 9).alias("premium"))


@query("j02_dual_listing_premium", with_(bars_sql(), """
, a AS (SELECT ts, close FROM bars WHERE symbol = (SELECT min(symbol) FROM bars)),
h AS (SELECT ts, close FROM bars WHERE symbol = (SELECT max(symbol) FROM bars))
SELECT a.ts, a.close AS a_close, h.close AS h_close, round((a.close - h.close) / h.close, 9) AS premium
FROM a ASOF LEFT JOIN h ON a.ts >= h.ts"""))
def _(spark, sf):
    b = feeds.bars(spark, sf)
    names = asof.universe_list(b)
    leg = lambda s: b.where(F.col("symbol") == s).select(F.lit("pair").alias("k"), "ts", "close")
    got = asof.asof_join(leg(names[0]), leg(names[-1]), ["k"], ["close"], suffix="_h")
    return got.select("ts", F.col("close").alias("a_close"), F.col("close_h").alias("h_close"),
                      F.round((F.col("close") - F.col("close_h")) / F.col("close_h"), 9).alias("premium"))


TICKS_NEXT_SQL = """
, n AS (SELECT t.symbol, t.event_id, t.ts, b.ts AS next_ts, b.close AS next_close
  FROM path t ASOF LEFT JOIN bars b ON t.symbol = b.symbol AND t.ts <= b.ts)"""


def tick_matches(spark, sf, direction, **how):
    t = feeds.price_path(spark, sf).select("symbol", "ts", "event_id")
    b = feeds.bars(spark, sf).withColumn("bar_ts", F.col("ts"))
    return asof.asof_match(t, b, ["symbol"], ["bar_ts", "close"], direction, suffix="_m", **how)


@query("j02_asof_forward_within", with_(bars_sql(), TICKS_NEXT_SQL + """
SELECT symbol, event_id, CASE WHEN next_ts - ts <= INTERVAL '5 minutes' THEN next_close END AS bar_close FROM n"""))
def _(spark, sf):
    return tick_matches(spark, sf, "forward", tolerance=300).select("symbol", "event_id", F.col("close_m").alias("bar_close"))


@query("j02_asof_nearest", with_(bars_sql(), TICKS_NEXT_SQL + """
, m AS (SELECT n.*, b.ts AS last_ts, b.close AS last_close FROM n ASOF LEFT JOIN bars b ON n.symbol = b.symbol AND n.ts >= b.ts),
c AS (SELECT *, last_ts IS NULL OR next_ts - ts < ts - last_ts AS ahead FROM m)
SELECT symbol, event_id, CASE WHEN ahead THEN next_ts ELSE last_ts END AS bar_ts, CASE WHEN ahead THEN next_close ELSE last_close END AS bar_close FROM c"""))
def _(spark, sf):
    return tick_matches(spark, sf, "nearest").select("symbol", "event_id", F.col("bar_ts_m").alias("bar_ts"), F.col("close_m").alias("bar_close"))


@query("j02_asof_strictly_before_within", with_(bars_sql(), """
, m AS (SELECT t.symbol, t.ts, b.ts AS last_ts, b.close FROM bars t ASOF LEFT JOIN bars b ON t.symbol = b.symbol AND t.ts > b.ts)
SELECT symbol, ts, CASE WHEN ts - last_ts <= INTERVAL '2 hours' THEN close END AS close_before FROM m"""))
def _(spark, sf):
    b = feeds.bars(spark, sf)
    got = asof.asof_match(b.select("symbol", "ts"), b, ["symbol"], ["close"], tolerance=7200, allow_exact=False, suffix="_before")
    return got.select("symbol", "ts", "close_before")


@query("e15_hedged_value", with_(bars_sql(), """
, s AS (SELECT symbol, ts, close FROM bars),
t AS (SELECT ts, close FROM bars WHERE symbol = (SELECT min(symbol) FROM bars))
SELECT s.symbol, s.ts, round(s.close - 2 * t.close, 6) AS hedged, round(s.close + t.close, 6) AS straddle
FROM s ASOF LEFT JOIN t ON s.ts >= t.ts"""))
def _(spark, sf):
    b = feeds.bars(spark, sf)
    first = asof.universe_list(b)[0]
    left = b.select(F.lit(1).alias("k"), "ts", "symbol", "close")
    right = b.where(F.col("symbol") == first).select(F.lit(1).alias("k"), "ts", "close")
    got = asof.asof_join(left, right, ["k"], ["close"], suffix="_o")
    return got.select("symbol", "ts", F.round(F.col("close") - 2 * F.col("close_o"), 6).alias("hedged"),
                      F.round(F.col("close") + F.col("close_o"), 6).alias("straddle"))


@query("j03_enumerate_pairs_in_group", """
WITH universe AS (SELECT r_name AS market, n_name AS grp, s_name AS symbol FROM supplier
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT a.market, a.grp, a.symbol || '_' || b.symbol AS pair, a.symbol AS n1, b.symbol AS n2 FROM universe a JOIN universe b
ON a.market = b.market AND a.grp = b.grp AND a.symbol < b.symbol""")
def _(spark, sf):
    return pairs.enumerate_pairs(universe(spark, sf), ["market", "grp"])


def universe(spark, sf):
    t = lambda n: feeds.table(spark, sf, n)
    return (t("supplier").join(t("nation"), F.expr("s_nationkey = n_nationkey"))
            .join(t("region"), F.expr("n_regionkey = r_regionkey"))
            .select(F.col("r_name").alias("market"), F.col("n_name").alias("grp"), F.col("s_name").alias("symbol")))


@query("j03_enumerate_pairs", with_(feeds.WEEKLY_SQL, """
SELECT a.symbol || '_' || b.symbol AS pair, a.symbol AS n1, b.symbol AS n2
FROM (SELECT DISTINCT symbol FROM weekly) a JOIN (SELECT DISTINCT symbol FROM weekly) b ON a.symbol < b.symbol"""))
def _(spark, sf):
    return pairs.enumerate_pairs(feeds.weekly(spark, sf))


@query("j04_pair_bars", with_(feeds.WEEKLY_SQL, """
SELECT a.symbol || '_' || b.symbol AS pair, a.ts, a.close AS x_close, b.close AS y_close
FROM weekly a JOIN weekly b ON a.ts = b.ts AND a.symbol < b.symbol"""))
def _(spark, sf):
    w = feeds.weekly(spark, sf)
    got = pairs.pair_bars(pairs.enumerate_pairs(w), w)
    return got.select("pair", "ts", "x_close", "y_close")


# Regression models of the event pairs, used by the watch lists below.
MODELS_SQL = panel_sql() + """,
fit AS (SELECT a.symbol AS n1, b.symbol AS n2, a.symbol || '_' || b.symbol AS pair, regr_slope(b.close, a.close) AS s,
  regr_intercept(b.close, a.close) AS i FROM panel a JOIN panel b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY 1, 2, 3),
models AS (SELECT f.pair, f.n1, f.n2, f.s, f.i, 0e0 AS m, stddev_samp(a.close * f.s + f.i - b.close) AS st
  FROM fit f JOIN panel a ON a.symbol = f.n1 JOIN panel b ON b.symbol = f.n2 AND a.ts = b.ts GROUP BY 1, 2, 3, 4, 5)"""
QUOTE_SQL = feeds.QUOTES_SQL[len(feeds.PATH_SQL):]


def models(spark, sf):
    both = pairs.all_pair_bars(feeds.panel(spark, sf), ["close"])
    y, x = F.col("y_close"), F.col("x_close")
    d = both.groupBy("n1", "n2").agg(
        F.count(F.lit(1)).alias("_n"), F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("i"),
        F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"))
    return d.select(F.concat_ws("_", "n1", "n2").alias("pair"), "n1", "n2", "s", "i", F.lit(0.0).alias("m"),
                    F.sqrt((F.col("_syy") - F.col("s") * F.col("_sxy")) / (F.col("_n") - 1)).alias("st"))


@query("j05_watch_pairs", with_(MODELS_SQL + QUOTE_SQL.replace("0.999e0", "0.9999e0").replace("1.001e0", "1.0001e0"), """
, z AS (SELECT pair, (a.BID * s + i - b.ASK - m) / st AS z1, (a.ASK * s + i - b.BID - m) / st AS z2,
  100 * st / greatest(a.LAST, b.LAST) AS st_price_pct, 1 / s AS y_per_x FROM models
  JOIN quotes a ON a.symbol = n1 JOIN quotes b ON b.symbol = n2 WHERE s > 0),
hit AS (SELECT * FROM z WHERE z1 > 0.5 OR z2 < -0.5 ORDER BY st_price_pct DESC, pair LIMIT 50)
SELECT pair, round(z1, 5) AS z1, round(z2, 5) AS z2, round(st_price_pct, 7) AS st_price_pct, round(y_per_x, 5) AS y_per_x FROM hit"""))
def _(spark, sf):
    got = pairs.watch_pairs(models(spark, sf), feeds.quotes(spark, sf, half_spread=0.0001), threshold=0.5)
    return got.select("pair", F.round("z1", 5).alias("z1"), F.round("z2", 5).alias("z2"),
                      F.round("st_price_pct", 7).alias("st_price_pct"), F.round("y_per_x", 5).alias("y_per_x"))


@query("j05_watch_mark", with_(MODELS_SQL + QUOTE_SQL, """
, z AS (SELECT pair, (a.LAST * s + i - b.LAST - m) / st AS z FROM models
  JOIN quotes a ON a.symbol = n1 JOIN quotes b ON b.symbol = n2)
SELECT pair, round(z, 5) AS z FROM z WHERE abs(z) > 0.5"""))
def _(spark, sf):
    return pairs.watch_mark(models(spark, sf), feeds.quotes(spark, sf), 0.5).select("pair", F.round("z", 5).alias("z"))


HELD_SQL = """,
held AS (SELECT symbol, CAST(sum(CASE WHEN event_id % 2 = 0 THEN size ELSE -size END) AS DOUBLE) AS position
  FROM ticks GROUP BY symbol)"""


def held(spark, sf):
    t = feeds.ticks(spark, sf)
    side = F.when(F.col("event_id") % 2 == 0, F.col("size")).otherwise(-F.col("size"))
    return t.groupBy("symbol").agg(F.sum(side).cast("double").alias("position"))


@query("j06_watch_positions", with_(MODELS_SQL + QUOTE_SQL + HELD_SQL, """
SELECT pair, round(x.LAST, 6) AS x_price, a.position AS x_pos, round(y.LAST, 6) AS y_price, b.position AS y_pos,
  round((x.LAST * s + i - y.LAST - m) / st, 5) AS z_diff FROM models
JOIN held a ON a.symbol = n1 JOIN held b ON b.symbol = n2 JOIN quotes x ON x.symbol = n1 JOIN quotes y ON y.symbol = n2
WHERE abs(a.position) >= 1 AND abs(b.position) >= 1"""))
def _(spark, sf):
    got = pairs.watch_positions(held(spark, sf), feeds.quotes(spark, sf), models(spark, sf))
    return got.select("pair", F.round("x_price", 6).alias("x_price"), "x_pos", F.round("y_price", 6).alias("y_price"),
                      "y_pos", F.round("z_diff", 5).alias("z_diff"))


MARKET_SQL = """
market AS (SELECT o_orderpriority AS symbol, avg(o_totalprice) / 1000 AS last, max(o_totalprice) / 1000 AS close
  FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' GROUP BY 1)"""


@query("j07_insider_vs_market", with_(MARKET_SQL, """
SELECT o_orderkey, o_orderpriority AS ticker, round((last - cost) / cost * 100, 4) AS mark_cost_pct,
  round((close - cost) / cost * 100, 4) + 0 AS close_cost_pct
FROM (SELECT o_orderkey, o_orderpriority, round(o_totalprice / 1000, 5) AS cost FROM orders)
LEFT JOIN market ON o_orderpriority = symbol"""))
def _(spark, sf):
    o = feeds.table(spark, sf, "orders")
    market = (o.where("o_orderstatus = 'F' and o_orderpriority <> '1-URGENT'").groupBy(F.col("o_orderpriority").alias("symbol"))
              .agg((F.avg("o_totalprice") / 1000).alias("LAST"), (F.max("o_totalprice") / 1000).alias("CLOSE")))
    got = pairs.insider_vs_market(insiders(spark, sf), market)
    return got.select("o_orderkey", "ticker", F.round("mark_cost_pct", 4).alias("mark_cost_pct"),
                      F.round("close_cost_pct", 4).alias("close_cost_pct"))


@query("e10_pct_vs_cost", """
SELECT o_orderkey, round((o_totalprice - c_acctbal) / nullif(c_acctbal, 0) * 100, 4) AS pct FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(spark, sf):
    o, c = feeds.table(spark, sf, "orders"), feeds.table(spark, sf, "customer")
    return (o.join(c, F.expr("o_custkey = c_custkey"))
            .select("o_orderkey", F.round(pairs.pct_vs_cost("o_totalprice", "c_acctbal"), 4).alias("pct")))


def plate_rows(spark, sf):
    """(stock, plate) membership: a brand is on the plate of a type when its parts of that type are large on average.

    Without the condition every brand would be on every plate.
    """
    p = feeds.table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.sum("p_size").alias("size"), F.count(F.lit(1)).alias("n"))
    return p.where("size > 25 * n").select(F.concat(F.lit("US."), F.col("p_brand")).alias("code"), F.col("p_type").alias("plate"))


@query("s07_invert_plates", """
SELECT p_brand AS symbol, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS plates, CAST(count(DISTINCT p_type) AS BIGINT) AS n,
  CAST(count(DISTINCT p_type) AS DOUBLE) AS weight FROM (SELECT p_brand, p_type FROM part GROUP BY 1, 2 HAVING sum(p_size) > 25 * count(*)) GROUP BY 1""")
def _(spark, sf):
    from tandem.sources.plates import invert_plates
    m = invert_plates(plate_rows(spark, sf))
    return m.select("symbol", F.array_join(F.array_sort(F.map_keys("plates")), ",").alias("plates"), F.size("plates").cast("bigint").alias("n"),
                    F.aggregate(F.map_values("plates"), F.lit(0.0), lambda a, v: a + v).alias("weight"))


@query("j08_shared_plates", """
WITH b AS (SELECT DISTINCT p_brand AS symbol FROM part), m AS (SELECT DISTINCT p_brand AS symbol, p_type FROM (SELECT p_brand, p_type FROM part GROUP BY 1, 2 HAVING sum(p_size) > 25 * count(*))),
pairs AS (SELECT x.symbol AS n1, y.symbol AS n2 FROM b x JOIN b y ON x.symbol < y.symbol),
common AS (SELECT n1, n2, string_agg(lower(x.p_type), ',' ORDER BY lower(x.p_type)) AS plates FROM pairs JOIN m x ON x.symbol = n1
  JOIN m y ON y.symbol = n2 AND x.p_type = y.p_type GROUP BY 1, 2)
SELECT n1 || '_' || n2 AS pair, CASE WHEN n1 IN (SELECT symbol FROM m) THEN upper(n1) ELSE '' END || '-' ||
  CASE WHEN n2 IN (SELECT symbol FROM m) THEN upper(n2) ELSE '' END || '-' || coalesce(plates, '') AS ext
FROM pairs LEFT JOIN common USING (n1, n2)""")
def _(spark, sf):
    from tandem.sources.plates import invert_plates
    part = feeds.table(spark, sf, "part")
    stocks = invert_plates(plate_rows(spark, sf)).withColumn("stock_name", F.upper("symbol"))
    names = part.select(F.col("p_type").alias("code"), F.lower("p_type").alias("name")).distinct()
    p = pairs.enumerate_pairs(part.select(F.col("p_brand").alias("symbol")))
    return pairs.shared_plates(p, stocks, names)


SCREEN_SQL = """
screener AS (SELECT p_partkey AS symbol, p_retailprice AS price, CAST(sum(l_quantity) AS BIGINT) AS volume,
  p_retailprice * p_size * 1000 AS market_cap FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2, p_size)"""


def screener(spark, sf):
    part, li = feeds.table(spark, sf, "part"), feeds.table(spark, sf, "lineitem")
    vol = li.groupBy("l_partkey").agg(F.sum("l_quantity").cast("bigint").alias("volume"))
    return (part.join(vol, F.expr("p_partkey = l_partkey"))
            .select(F.col("p_partkey").alias("symbol"),
                    clean.parse_money(F.concat(F.lit("$"), F.col("p_retailprice").cast("string"))).alias("price"),
                    "volume", (F.col("p_retailprice") * F.col("p_size") * 1000).alias("market_cap")))


@query("j09_screen_universe", with_(SCREEN_SQL, """
, d AS (SELECT *, price * volume AS volume_dollar FROM screener WHERE price > 5)
SELECT symbol, round(volume_dollar, 2) AS volume_dollar FROM (SELECT * FROM d ORDER BY volume_dollar DESC, symbol LIMIT 300)
WHERE symbol IN (SELECT symbol FROM d ORDER BY market_cap DESC, symbol LIMIT 400)"""))
def _(spark, sf):
    got = pairs.screen_universe(screener(spark, sf), 300, 400)
    return got.select("symbol", F.round("volume_dollar", 2).alias("volume_dollar"))


@query("j10_attach_models", with_(MODELS_SQL, """
SELECT pair, round(s, 6) AS s, round(i, 4) AS i, round(c.corr, 6) AS corr FROM models JOIN (SELECT a.symbol || '_' || b.symbol AS pair,
  corr(a.close, b.close) AS corr FROM panel a JOIN panel b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY 1) c USING (pair)"""))
def _(spark, sf):
    c = (pairs.all_pair_bars(feeds.panel(spark, sf), ["close"]).groupBy(F.concat_ws("_", "n1", "n2").alias("pair"))
         .agg(F.corr("x_close", "y_close").alias("corr")))
    got = pairs.attach_models(models(spark, sf), c)
    return got.select("pair", F.round("s", 6).alias("s"), F.round("i", 4).alias("i"), F.round("corr", 6).alias("corr"))


@query("j11_missing_symbols", """
SELECT DISTINCT c_name AS symbol FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def _(spark, sf):
    o, c = feeds.table(spark, sf, "orders"), feeds.table(spark, sf, "customer")
    seen = o.where("o_orderstatus = 'F'").select(F.format_string("Customer#%09d", "o_custkey").alias("symbol"))
    return pairs.missing_symbols(c.select(F.col("c_name").alias("symbol")), seen)


@query("j12_calendar_chain", """
SELECT CAST(day AS VARCHAR) AS day, CAST(lag(day) OVER (ORDER BY day) AS VARCHAR) AS prev_day FROM
(SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem)""")
def _(spark, sf):
    li = feeds.table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("ts"))
    return clean.calendar_chain(li).select(F.col("day").cast("string").alias("day"), F.col("prev_day").cast("string").alias("prev_day"))


@query("j13_outer_align", with_(bars_sql(), """
SELECT s.symbol, t.ts, b.open, b.close FROM (SELECT DISTINCT ts FROM bars) t CROSS JOIN (SELECT DISTINCT symbol FROM bars) s
LEFT JOIN bars b ON b.symbol = s.symbol AND b.ts = t.ts"""))
def _(spark, sf):
    b = feeds.bars(spark, sf)
    return asof.outer_align(b, asof.universe_list(b), ["open", "close"])


@query("u01_concat_bars", with_(bars_sql("1 hour") + "," + feeds.DAILY_SQL, """
SELECT symbol, ts, close FROM bars UNION ALL SELECT symbol, ts, close FROM daily"""))
def _(spark, sf):
    pick = lambda d: d.select("symbol", "ts", "close")
    return pairs.concat_bars(pick(feeds.bars(spark, sf, "1 hour")), pick(feeds.daily(spark, sf)))


@query("u02_symbol_union", with_(bars_sql("1 hour") + "," + feeds.DAILY_SQL + "," + feeds.trades_sql("p_brand").replace("trades", "t2"), """
SELECT DISTINCT symbol FROM bars UNION SELECT DISTINCT symbol FROM daily UNION SELECT DISTINCT symbol FROM t2"""))
def _(spark, sf):
    return pairs.symbol_union(feeds.bars(spark, sf, "1 hour"), feeds.daily(spark, sf),
                              pairs.enumerate_pairs(feeds.weekly(spark, sf)))


@query("u03_merge_big_tables", with_(feeds.DAILY_SQL, """
, a AS (SELECT * FROM daily WHERE ts < TIMESTAMP '2000-01-01'), b AS (SELECT * FROM daily WHERE ts >= TIMESTAMP '1999-12-01'),
aa AS (SELECT * FROM a WHERE ts IN (SELECT ts FROM a GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM daily))),
bb AS (SELECT * REPLACE (close + 1 AS close) FROM b WHERE ts IN (SELECT ts FROM b GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM daily))),
m AS (SELECT *, 0 AS src FROM aa UNION ALL SELECT *, 1 FROM bb),
d AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY src) = 1)
SELECT symbol, ts, close FROM d WHERE symbol IN
  (SELECT symbol FROM d GROUP BY symbol HAVING count(*) = (SELECT count(DISTINCT ts) FROM d))"""))
def _(spark, sf):
    d = feeds.daily(spark, sf).select("symbol", "ts", "close")
    base = d.where(F.col("ts") < F.lit("2000-01-01").cast("timestamp_ntz"))
    late = d.where(F.col("ts") >= F.lit("1999-12-01").cast("timestamp_ntz")).withColumn("close", F.col("close") + 1)
    got = pairs.merge_big_tables(base, late, asof.universe_list(d), ["close"])
    return got.select("symbol", "ts", "close")


@query("t03_tail_after_sort", with_(MODELS_SQL, """
SELECT pair, round(st, 6) AS st FROM (SELECT pair, st FROM models ORDER BY st DESC, pair LIMIT 50)"""))
def _(spark, sf):
    top = models(spark, sf).orderBy(F.desc("st"), "pair").limit(50)
    return top.select("pair", F.round("st", 6).alias("st")).orderBy("st")
