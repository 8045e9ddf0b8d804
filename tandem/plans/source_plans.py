"""Readers and writers, driven by files written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.operators.asof import universe_list
from tandem.plans import feeds
from tandem.plans.feeds import bars_sql, with_
from tandem.plans.registry import query
from tandem.plans.signal_plans import LEG_SQL, leg_trades
from tandem.sources import bars as sb, models as sm, plates as spl
from tandem.sources.shared import fresh_path

FIELDS = ["open", "high", "low", "close", "volume"]
ROUND_TRIP_SQL = "SELECT s.symbol, t.ts, b.open, b.high, b.low, b.close, b.volume FROM (SELECT DISTINCT ts FROM bars) t CROSS JOIN (SELECT DISTINCT symbol FROM bars) s LEFT JOIN bars b ON b.ts = t.ts AND b.symbol = s.symbol"


@query("s01_read_bars_wide", with_(bars_sql("1 hour"), ROUND_TRIP_SQL))
def _(spark, sf):
    b = feeds.bars(spark, sf, "1 hour")
    path = fresh_path(spark, "wide")
    sb.write_bars_wide(b, universe_list(b), path, FIELDS)
    return sb.read_bars_wide(spark, path).select("symbol", "ts", *FIELDS)


@query("s01_read_bars_wide_whole_rows", with_(bars_sql("1 hour"), """
SELECT symbol, ts, close FROM bars WHERE ts IN (SELECT ts FROM bars GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM bars))"""))
def _(spark, sf):
    b = feeds.bars(spark, sf, "1 hour")
    path = fresh_path(spark, "wide")
    sb.write_bars_wide(b, universe_list(b), path, FIELDS)
    return sb.read_bars_wide(spark, path, drop_gaps=True).select("symbol", "ts", "close")


@query("s02_read_bars_flat", with_(bars_sql("1 hour"), ROUND_TRIP_SQL))
def _(spark, sf):
    b = feeds.bars(spark, sf, "1 hour")
    path = fresh_path(spark, "flat")
    sb.write_bars_flat(b, universe_list(b), path, FIELDS)
    return sb.read_bars_flat(spark, path).select("symbol", "ts", *FIELDS)


@query("s15_write_bars_flat", with_(bars_sql("1 hour"), """
SELECT strftime(ts, '%Y%m%d  %H:%M:%S') AS time, """ + ", ".join(
    f"max({f}) FILTER (symbol = '{s}') AS {f}_{s}" for s in ("click", "error", "purchase", "signup", "view") for f in ("open", "close")) + " FROM bars GROUP BY ts"))
def _(spark, sf):
    b = feeds.bars(spark, sf, "1 hour")
    path = fresh_path(spark, "flat")
    names = universe_list(b)
    sb.write_bars_flat(b, names, path, ["open", "close"])
    raw = spark.read.option("header", True).csv(path)
    return raw.select("time", *[F.col(f"{f}_{s}").cast("double").alias(f"{f}_{s}") for s in names for f in ("open", "close")])


@query("s03_read_kline", with_(bars_sql("1 hour"), "SELECT symbol, 'K1M' AS ktype, ts, open, high, low, close, volume FROM bars"))
def _(spark, sf):
    b = feeds.bars(spark, sf, "1 hour")
    root = fresh_path(spark, "kline")
    for s in universe_list(b):  # one file per symbol is the layout this reader exists for
        one = b.where(F.col("symbol") == s).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time_key"), F.col("symbol").alias("code"),
                                                   "open", "close", "high", "low", "volume", (F.col("close") * F.col("volume")).alias("turnover"))
        one.write.option("header", True).csv(f"{root}/{s}.K1M.csv")
    return sb.read_kline(spark, root).drop("turnover")


@query("s04_file_inventory", """
WITH n AS (SELECT o_orderkey, c_name AS symbol, strftime(o_orderdate, '%Y%m%d') AS start, strftime(o_orderdate + INTERVAL '30 days', '%Y%m%d') AS "end" FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 10 <> 0)
SELECT CAST(o_orderkey AS VARCHAR) AS seq, symbol, start, "end", '5m' AS interval, count(*) OVER (PARTITION BY start, "end") AS files FROM n""")
def _(spark, sf):
    return sb.group_inventory(inventory(spark, sf))


def inventory(spark, sf):
    """File names as an inventory listing would give them; every tenth name is malformed."""
    o, c = feeds.table(spark, sf, "orders"), feeds.table(spark, sf, "customer")
    day = lambda d: F.date_format(d, "yyyyMMdd")
    name = F.concat_ws("-", F.col("o_orderkey").cast("string"), "c_name", day("o_orderdate"), day(F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")), F.lit("5m.csv"))
    files = o.join(c, F.expr("o_custkey = c_custkey")).select(F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("x-"), name)).otherwise(name).alias("name"))
    return sb.parse_inventory(files)


@query("s06_plates_round_trip", """
SELECT p_brand AS symbol, string_agg(DISTINCT lower(p_type), ',' ORDER BY lower(p_type)) AS names, CAST(count(DISTINCT p_type) AS DOUBLE) AS weight FROM (SELECT p_brand, p_type FROM part GROUP BY 1, 2 HAVING sum(p_size) > 25 * count(*)) GROUP BY 1""")
def _(spark, sf):
    from tandem.plans.join_plans import plate_rows
    stocks = spl.invert_plates(plate_rows(spark, sf)).withColumns({"stock_name": F.upper("symbol"), "list_time": F.lit("2020-01-01")})
    names = feeds.table(spark, sf, "part").select(F.col("p_type").alias("code"), F.lower("p_type").alias("name")).distinct()
    path = fresh_path(spark, "plates")
    spl.write_plates(stocks, names, path, parts=4)
    back, back_names = spl.read_plates(spark, path)
    flat = back.select("symbol", F.explode("plates").alias("code", "w")).join(back_names.distinct(), "code")
    return flat.groupBy("symbol").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"), F.sum("w").alias("weight"))


@query("s08_read_pairs", with_(LEG_SQL, """
SELECT scenario || '_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS pair, slope AS s, CASE WHEN scenario = 'R' THEN x0 END AS i, y0 AS m FROM legs"""))
def _(spark, sf):
    t = leg_trades(spark, sf)
    pair = F.concat_ws("_", "scenario", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    root = fresh_path(spark, "pairs")
    r = t.where("scenario = 'R'").select(pair.alias("pair"), F.col("slope").alias("s"), F.col("x0").alias("i"), F.col("y0").alias("m"))
    o = t.where("scenario <> 'R'").select(F.col("y0").alias("m"), pair.alias("pair"), F.col("slope").alias("s"))
    r.write.option("header", True).csv(f"{root}/a")
    o.write.option("header", True).csv(f"{root}/b")
    return sm.read_pairs(spark, f"{root}/a", f"{root}/b").select("pair", "s", "i", "m")


@query("s09_models_round_trip", with_(LEG_SQL, """
SELECT n1 || '_' || n2 AS pair, CAST(round((slope - 0.2e0) * 20) AS INTEGER) AS coint_days, round(slope, 5) AS s_0, round(x1, 5) AS s_dayslr, CAST(epoch_ms(tm_o) AS BIGINT) AS start,
  '2024-01-12' AS model_date, 'cn' AS grp FROM legs"""))
def _(spark, sf):
    t = leg_trades(spark, sf)
    root = fresh_path(spark, "models") + "/2024-01-12.cn/js_coint_v2.json"
    m = t.select(F.concat_ws("_", "n1", "n2").alias("pair"), F.round((F.col("slope") - 0.2) * 20).cast("int").alias("coint_days"),
                 F.col("slope").alias("s_0"), F.col("x1").alias("s_dayslr"), F.col("tm_o").alias("start"))
    sm.write_models(m, root)
    date, group = sm.model_path_key("path")
    return sm.read_models(spark, root).select("pair", "coint_days", "s_0", "s_dayslr", "start", date.alias("model_date"), group.alias("grp"))


@query("s10_model_path_key", """
SELECT o_orderkey, strftime(o_orderdate + INTERVAL '20 years', '%Y-%m-%d') AS model_date, lower(replace(o_orderpriority, ' ', '')) AS grp FROM orders""")
def _(spark, sf):
    o = feeds.table(spark, sf, "orders")
    path = F.concat(F.lit("/data/study/"), F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 20 YEARS"), "yyyy-MM-dd"), F.lit("."), F.lower(F.replace(F.col("o_orderpriority"), F.lit(" "), F.lit(""))),
                    F.when(F.col("o_orderkey") % 2 == 0, "/ols.csv").otherwise("/js_coint_v2.json"))
    date, group = sm.model_path_key(path)
    return o.select("o_orderkey", date.alias("model_date"), group.alias("grp"))


@query("s11_read_universe", """
SELECT DISTINCT r_name AS market, n_name AS grp, replace(c_name, '#', ' ') AS symbol FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def _(spark, sf):
    t = lambda n: feeds.table(spark, sf, n)
    rows = (t("customer").join(t("nation"), F.expr("c_nationkey = n_nationkey")).join(t("region"), F.expr("n_regionkey = r_regionkey")))
    lists = rows.select(F.col("r_name").alias("market"), F.col("n_name").alias("grp"),
                        F.concat(F.lit(" "), F.replace(F.col("c_name"), F.lit("#"), F.lit("/")), F.lit(", ,")).alias("symbols"))
    return sm.read_universe(lists, ["market", "grp"])


@query("s12_read_screener", """
SELECT p_partkey AS id, p_retailprice AS price, CAST(sum(l_quantity) AS BIGINT) AS volume, p_retailprice * p_size * 1000 AS market_cap FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2, p_size""")
def _(spark, sf):
    part, li = feeds.table(spark, sf, "part"), feeds.table(spark, sf, "lineitem")
    vol = li.groupBy("l_partkey").agg(F.sum("l_quantity").cast("bigint").alias("v"))
    rows = part.join(vol, F.expr("p_partkey = l_partkey")).select(
        F.concat(F.col("p_partkey").cast("string"), F.lit(" ")).alias("Symbol"), F.concat(F.lit("$"), F.col("p_retailprice").cast("string")).alias("Last Sale"),
        F.col("v").alias("Volume"), (F.col("p_retailprice") * F.col("p_size") * 1000).alias("Market Cap"))
    path = fresh_path(spark, "screener")
    rows.write.option("header", True).csv(path)
    return sm.read_screener(spark, path).select(F.col("symbol").cast("bigint").alias("id"), "price", "volume", "market_cap")


@query("s12_read_insiders", """
SELECT o_orderpriority AS ticker, CAST(o_orderkey AS VARCHAR) AS owner, o_totalprice / 1000 AS cost, CAST(floor(o_totalprice) AS BIGINT) AS value, o_orderdate AS dt FROM orders""")
def _(spark, sf):
    o = feeds.table(spark, sf, "orders")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    rows = o.select(F.col("o_orderpriority").alias("ticker"), F.col("o_orderkey").alias("owner"), F.lit("Director").alias("Relationship"),
                    (F.col("o_totalprice") / 1000).alias("cost"), F.floor("o_totalprice").alias("value"), stamp.alias("dt"), stamp.alias("dt_sec"),
                    F.lit(None).cast("double").alias("markPrice"), F.lit(None).cast("double").alias("close"), F.lit("Buy").alias("T"),
                    F.lit(None).cast("double").alias("% markPrice_cost"), F.lit(None).cast("double").alias("% close_cost"))
    path = fresh_path(spark, "insiders")
    rows.write.option("header", True).csv(path)
    return sm.read_insiders(spark, path).select("ticker", "owner", "cost", "value", "dt")


@query("s16_scenario_results", with_(LEG_SQL, """
SELECT strftime(tm_o, '%Y-%m-%d') AS scenario, n1 || '_' || n2 AS name, count(*) AS trades, round(sum(round(profit, 5)), 7) + 0 AS profit, CAST(any_value(length(n1)) AS INTEGER) AS model_width FROM pnl GROUP BY 1, 2"""))
def _(spark, sf):
    t = leg_trades(spark, sf).withColumns({"pair": F.concat_ws("_", "n1", "n2"), "scenario": F.date_format("tm_o", "yyyy-MM-dd")})
    trades = t.select("scenario", "pair", F.round("profit", 5).alias("profit"), "x0", "x1", "pos_x", "y0", "y1", "pos_y", "tm_o")
    models = t.select("scenario", "pair", F.length("n1").alias("width")).distinct()
    path = fresh_path(spark, "results")
    sm.write_results(sm.scenario_results(models, trades, ["scenario"]), path)
    back = spark.read.schema("scenario STRING, contracts ARRAY<STRUCT<name: STRING, trades: ARRAY<STRUCT<profit: DOUBLE>>, model: STRUCT<width: INT>>>").json(path)
    c = back.select("scenario", F.explode("contracts").alias("c"))
    total = F.aggregate("c.trades", F.lit(0.0), lambda a, x: a + x["profit"])
    return c.select("scenario", F.col("c.name").alias("name"), F.size("c.trades").cast("bigint").alias("trades"), F.round(total, 7).alias("profit"),
                    F.col("c.model.width").alias("model_width"))


@query("s05_write_bars_sharded", with_(bars_sql("1 hour"), "SELECT symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, max(close) AS top FROM bars GROUP BY 1, 2"))
def _(spark, sf):
    path = fresh_path(spark, "sharded")
    sb.write_bars_sharded(feeds.bars(spark, sf, "1 hour"), path)
    d = spark.read.parquet(path)
    return d.where(F.col("shard") == sb.shard_of(F.col("symbol"))).groupBy("symbol", F.col("day").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.max("close").alias("top"))
