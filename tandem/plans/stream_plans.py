"""Streaming queries: each runs over the table as a stream and reads its result back."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tandem.operators import pairs as pr
from tandem.operators.resample import sequence_key
from tandem.plans import feeds
from tandem.plans.feeds import PATH_SQL, bars_sql, panel_sql, with_
from tandem.plans.join_plans import HELD_SQL, MODELS_SQL, QUOTE_SQL, held, models
from tandem.plans.registry import query
from tandem.plans.signal_plans import LEGS_OUT, LIMITS, V1_SQL, legs_out, spread_rows
from tandem.streaming import feeds as sf_, quotes as sq
from tandem.streaming import push, windows as sw
from tandem.streaming.signals import live_signals
from tandem.sources.shared import fresh_path


def tick_table(spark, sf):
    """The price path as a stored table (zone-free times taken as UTC)."""
    return feeds.stored(spark, sf, "path", lambda: feeds.price_path(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")))


def tick_stream(spark, sf):
    """The price path as a stream of files."""
    table = tick_table(spark, sf)
    folder = table.inputFiles()[0].rsplit("/", 1)[0]
    return spark.readStream.schema(table.schema).parquet(folder)


def bar_stream(spark, sf):
    table = feeds.stored(spark, sf, "bars-stream", lambda: feeds.bars(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")))
    folder = table.inputFiles()[0].rsplit("/", 1)[0]
    return spark.readStream.schema(table.schema).parquet(folder)


def _ntz(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query("s13_stream_ticker_feed", "SELECT event_type AS code, ts AS time, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume, event_id AS sequence FROM events")
def _(spark, sf):
    path = fresh_path(spark, "ticker")
    t = feeds.ticks(spark, sf)
    t.select(F.col("symbol").alias("code"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("time"), F.col("value").alias("price"),
             F.col("size").alias("volume"), F.col("event_id").alias("sequence")).write.json(path)
    got = sf_.drain(sf_.stream_feed(spark, "ticker", path), "ticker-out")
    return _ntz(got.select("code", "time", "price", "volume", "sequence"), "time")


@query("s13_stream_kline_quote_intraday", with_(bars_sql("1 hour"), """
SELECT symbol AS code, 'kline' AS feed, ts AS time, close AS price, volume FROM bars UNION ALL SELECT symbol, 'intraday', ts, close, volume FROM bars
UNION ALL SELECT symbol, 'quote', ts, close, volume FROM bars"""))
def _(spark, sf):
    b = feeds.bars(spark, sf, "1 hour")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    rows = {
        "kline": b.select(F.col("symbol").alias("code"), iso.alias("time_key"), "open", "close", "high", "low", "volume"),
        "intraday": b.select(F.col("symbol").alias("code"), iso.alias("time"), F.col("close").alias("cur_price"), "volume"),
        "quote": b.select(F.col("symbol").alias("code"), F.date_format("ts", "yyyy-MM-dd").alias("data_date"), F.date_format("ts", "HH:mm:ss").alias("data_time"),
                          F.col("close").alias("last_price"), "volume")}
    out = None
    for kind, d in rows.items():
        path = fresh_path(spark, kind)
        d.write.json(path)
        got = sf_.drain(sf_.stream_feed(spark, kind, path), f"{kind}-out")
        time = {"kline": F.col("time_key").cast("timestamp_ntz"), "intraday": F.col("time").cast("timestamp_ntz"),
                "quote": F.to_timestamp_ntz(F.concat_ws(" ", "data_date", "data_time"))}[kind]
        price = {"kline": "close", "intraday": "cur_price", "quote": "last_price"}[kind]
        part = got.select("code", F.lit(kind).alias("feed"), time.alias("time"), F.col(price).alias("price"), "volume")
        out = part if out is None else out.unionByName(part)
    return out


@query("s14_sink_hourly", "SELECT strftime(ts, '%Y%m%d') AS date, strftime(ts, '%H') AS hour, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1, 2")
def _(spark, sf):
    path, checkpoint = fresh_path(spark, "hourly"), fresh_path(spark, "hourly-checkpoint")
    sf_.sink_hourly(tick_stream(spark, sf), path, checkpoint, availableNow=True).awaitTermination()
    d = spark.read.schema("event_id BIGINT, date STRING, hour STRING").parquet(path)
    return d.groupBy("date", "hour").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("r01_latest_quote", with_(feeds.QUOTES_SQL, "SELECT symbol, round(BID, 6) AS BID, round(ASK, 6) AS ASK, LAST, CLOSE FROM quotes"))
def _(spark, sf):
    q = sq.latest_quote(sf_.quote_fields(tick_stream(spark, sf)))
    got = sf_.drain_batches(q, lambda d, _: d, "latest-quote")
    return got.select("symbol", F.round("BID", 6).alias("BID"), F.round("ASK", 6).alias("ASK"), "LAST", "CLOSE")


@query("r01_latest_quote_batch", with_(feeds.QUOTES_SQL, "SELECT symbol, LAST, CLOSE FROM quotes"))
def _(spark, sf):
    return sq.latest_quote(sf_.quote_fields(feeds.price_path(spark, sf))).select("symbol", "LAST", "CLOSE")


@query("r02_stream_watch_pairs", with_(MODELS_SQL + QUOTE_SQL.replace("0.999e0", "0.9999e0").replace("1.001e0", "1.0001e0"), """
, z AS (SELECT pair, (a.BID * s + i - b.ASK - m) / st AS z1, (a.ASK * s + i - b.BID - m) / st AS z2, 100 * st / greatest(a.LAST, b.LAST) AS p FROM models
  JOIN quotes a ON a.symbol = n1 JOIN quotes b ON b.symbol = n2 WHERE s > 0)
SELECT pair, round(z1, 4) AS z1, round(z2, 4) AS z2 FROM z WHERE z1 > 0.5 OR z2 < -0.5 ORDER BY p DESC, pair LIMIT 50"""))
def _(spark, sf):
    q = sq.latest_quote(sf_.quote_fields(tick_stream(spark, sf), half_spread=0.0001))
    m = models(spark, sf)
    got = sf_.drain_batches(q, sq.watch_handler(m, threshold=0.5), "watch")
    return got.select("pair", F.round("z1", 4).alias("z1"), F.round("z2", 4).alias("z2"))


@query("r03_stream_pair_join", with_(MODELS_SQL, """
SELECT pair, a.ts, round((m.s * a.close + m.i - b.close - m.m) / m.st, 4) + 0 AS z FROM models m JOIN bars a ON a.symbol = n1 JOIN bars b ON b.symbol = n2 AND a.ts = b.ts"""))
def _(spark, sf):
    m = models(spark, sf).select("pair", "n1", "n2", "s", "i", "m", "st")
    got = sf_.drain(sq.stream_pair_join(bar_stream(spark, sf), m), "pair-join")
    return _ntz(got, "ts").select("pair", "ts", F.round("z", 4).alias("z"))


@query("r04_stream_signals", V1_SQL + f" SELECT {LEGS_OUT} FROM legs")
def _(spark, sf):
    rows = spread_rows(spark, sf).where("role > 0")
    path = fresh_path(spark, "signal-bars")
    rows.write.parquet(path)
    last = rows.agg(F.max("ts")).first()[0]
    # the feed's closing row: the watermark passes the last bar
    sf_.heartbeat(rows, path, "ts", last + timedelta(hours=1), n1="", n2="", role=1, rn=0, diff=0.0, p1=1.0, p2=1.0, lookback=4, slope=1.0)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    with sf_.rocks_state(spark):
        trades = sf_.drain(live_signals(stream, {**LIMITS, "session_secs": 7 * 86_400}), "signals")
    return legs_out(trades.where("reason <> 'open'"))


@query("r05_stream_bars", with_(bars_sql("1 hour"), """
SELECT symbol, ts, open, high, low, close, volume FROM bars WHERE ts + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'"""))
def _(spark, sf):
    t = tick_stream(spark, sf)
    micros = F.unix_micros("ts").cast("decimal(17,0)") * F.lit("1" + "0" * 20).cast("decimal(21,0)") + F.col("event_id").cast("decimal(20,0)")
    return _ntz(sf_.drain(sq.stream_bars(t, "1 hour", "10 minutes", micros), "stream-bars"), "ts")


@query("r06_book_top", """
WITH l AS (SELECT l_orderkey, floor(l_extendedprice / l_quantity) AS price, CAST(sum(l_quantity) AS BIGINT) AS volume, l_linestatus AS side FROM lineitem GROUP BY ALL),
s AS (SELECT l_orderkey, min(CASE WHEN side = 'O' THEN price END) AS best_ask, max(CASE WHEN side <> 'O' THEN price END) AS best_bid,
  CAST(coalesce(sum(CASE WHEN side = 'O' THEN volume END), 0) AS BIGINT) AS ask_depth, CAST(coalesce(sum(CASE WHEN side <> 'O' THEN volume END), 0) AS BIGINT) AS bid_depth,
  CAST(greatest(count(*) FILTER (side = 'O'), count(*) FILTER (side <> 'O')) AS INTEGER) AS levels FROM l GROUP BY 1)
SELECT *, round(best_ask - best_bid, 4) + 0 AS spread FROM s""")
def _(spark, sf):
    d = sq.book_top(books(spark, sf))
    return d.select("l_orderkey", "best_ask", "best_bid", "ask_depth", "bid_depth", "levels", F.round("spread", 4).alias("spread"))


def books(spark, sf):
    """Order books out of orders: each order's lines are the levels (an order has a handful)."""
    li = feeds.table(spark, sf, "lineitem")
    levels = li.groupBy("l_orderkey", "l_linestatus", F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("price")).agg(
        F.sum("l_quantity").cast("bigint").alias("volume"), F.count(F.lit(1)).cast("int").alias("order_num"))
    level = F.struct("price", "volume", "order_num")
    side = lambda o, asc: F.sort_array(F.collect_list(F.when((F.col("l_linestatus") == "O") == o, level)), asc=asc)
    return levels.groupBy("l_orderkey").agg(side(True, True).alias("Ask"), side(False, False).alias("Bid"))


@query("r07_dedup_stream", with_(bars_sql(), "SELECT symbol, ts, close FROM bars"))
def _(spark, sf):
    b = bar_stream(spark, sf).select("symbol", "ts", "close")
    again = b.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(2)))).drop("n")
    return _ntz(sf_.drain(sq.dedup_stream(again), "dedup"), "ts")


@query("r08_position_monitor", with_(MODELS_SQL + QUOTE_SQL + HELD_SQL, """
SELECT pair, a.position AS x_pos, b.position AS y_pos, round((x.LAST * s + i - y.LAST - m) / st, 4) + 0 AS z_diff FROM models
JOIN held a ON a.symbol = n1 JOIN held b ON b.symbol = n2 JOIN quotes x ON x.symbol = n1 JOIN quotes y ON y.symbol = n2
WHERE abs(a.position) >= 1 AND abs(b.position) >= 1"""))
def _(spark, sf):
    q = sq.latest_quote(sf_.quote_fields(tick_stream(spark, sf)))
    got = sf_.drain_batches(q, sq.position_handler(held(spark, sf), models(spark, sf)), "positions")
    return got.select("pair", "x_pos", "y_pos", F.round("z_diff", 4).alias("z_diff"))


def _bars_closed(spark, sf):
    """Hourly bars as a stream, under the time at which they are complete."""
    table = feeds.stored(spark, sf, "hours-stream", lambda: feeds.bars(spark, sf, "1 hour").select(
        F.col("symbol"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).cast("timestamp").alias("bar_ts"), F.col("close").alias("bar_close")))
    return spark.readStream.schema(table.schema).parquet(table.inputFiles()[0].rsplit("/", 1)[0])


@query("r09_interval_join", with_(bars_sql("1 hour"), """
SELECT p.symbol, p.event_id, p.ts, b.ts + INTERVAL '1 hour' AS bar_ts, round(p.price - b.close, 5) + 0 AS moved
FROM path p JOIN bars b ON b.symbol = p.symbol AND b.ts + INTERVAL '1 hour' <= p.ts AND p.ts < b.ts + INTERVAL '1 hour' + INTERVAL '5400 seconds'"""))
def _(spark, sf):
    ticks_ = tick_stream(spark, sf).select("symbol", "ts", "event_id", "price")
    got = sf_.drain(sw.interval_join(ticks_, _bars_closed(spark, sf), "symbol", 5400), "interval-join")
    return _ntz(got, "ts", "bar_ts").select("symbol", "event_id", "ts", "bar_ts", (F.round(F.col("price") - F.col("bar_close"), 5) + 0).alias("moved"))


#: Ticks of a symbol belong together while they follow each other within its gap.
GAP_SECS = 120
GAP_SQL = f"({GAP_SECS} * (1 + ascii(symbol) % 3))"
SESSIONS_SQL = f"""
gapped AS (SELECT *, {GAP_SQL} AS gap, lag(ts) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS before FROM path),
runs AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + to_seconds(gap) THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS run FROM gapped),
sessions AS (SELECT symbol, min(ts) AS start, max(ts) AS last_ts, count(*) AS n, arg_min(price, ROW(ts, event_id)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, ROW(ts, event_id)) AS close, any_value(gap) AS gap FROM runs GROUP BY symbol, run)"""


@query("r10_session_bars", with_(PATH_SQL + "," + SESSIONS_SQL, """
SELECT symbol, start AS ts, last_ts, n, open, high, low, close FROM sessions
WHERE last_ts + to_seconds(gap) <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'"""))
def _(spark, sf):
    order = F.struct("ts", "event_id")
    gap = F.lit(GAP_SECS) * (1 + F.ascii("symbol") % 3)
    with sf_.sessions_by_split(spark):
        return _ntz(sf_.drain(sw.session_bars(tick_stream(spark, sf), gap, "10 minutes", order), "sessions"), "ts", "last_ts")


#: Every tenth tick comes after all others.
SPLIT_SQL = """
arrived AS (SELECT *, event_id % 10 = 0 AS held FROM path),
limits AS (SELECT max(ts) - INTERVAL '600 seconds' AS least FROM arrived WHERE NOT held),
routed AS (SELECT a.*, held AND ts < least AS late FROM arrived a, limits)"""


def routed(spark, sf):
    """The late route over ticks that come in three steps, a micro-batch each: two halves by time without every tenth tick, then these."""
    def build():
        ticks_ = tick_table(spark, sf).select("symbol", "ts", "event_id", "price")
        path, folder, checkpoint = (fresh_path(spark, n) for n in ("arrivals", "routed", "routed-checkpoint"))
        half = ticks_.agg(F.expr("timestamp_micros((unix_micros(min(ts)) + unix_micros(max(ts))) div 2)")).first()[0]
        held = F.col("event_id") % 10 == 0
        route = sw.LateRoute(spark, folder, delay_secs=600)
        sw.in_steps(ticks_, path, [~held & (F.col("ts") < F.lit(half)), ~held, F.lit(True)], lambda: route.start(
            spark.readStream.schema(ticks_.schema).parquet(path), checkpoint, availableNow=True).awaitTermination())
        return (route.read("on_time", ticks_.schema).withColumn("late", F.lit(False))
                .unionByName(route.read("late", ticks_.schema).withColumn("late", F.lit(True))))
    return feeds.stored(spark, sf, "routed", build)


@query("r11_late_route", with_(PATH_SQL + "," + SPLIT_SQL, """
SELECT symbol, late, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, min(ts) AS first_ts FROM routed GROUP BY 1, 2"""))
def _(spark, sf):
    got = routed(spark, sf).groupBy("symbol", "late").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.min("ts").alias("first_ts"))
    return _ntz(got, "first_ts")


@query("r11_sessions_in_time", with_(PATH_SQL + "," + SPLIT_SQL + "," + SESSIONS_SQL.replace("FROM path)", "FROM routed WHERE NOT late)"), """
SELECT symbol, start AS ts, last_ts, n, open, close FROM sessions
WHERE last_ts + to_seconds(gap) <= (SELECT max(ts) FROM routed WHERE NOT late) - INTERVAL '10 minutes'"""))
def _(spark, sf):
    table = feeds.stored(spark, sf, "in-time", lambda: routed(spark, sf).where("NOT late").drop("late"))
    stream = spark.readStream.schema(table.schema).parquet(table.inputFiles()[0].rsplit("/", 1)[0])
    with sf_.sessions_by_split(spark):
        got = sf_.drain(sw.session_bars(stream, F.lit(GAP_SECS) * (1 + F.ascii("symbol") % 3), "10 minutes", F.struct("ts", "event_id")), "sessions-in-time")
    return _ntz(got, "ts", "last_ts").select("symbol", "ts", "last_ts", "n", "open", "close")


TICKER = "code STRING, time TIMESTAMP, price DOUBLE, volume DOUBLE, sequence BIGINT"


def _push_lines(spark, sf):
    """Ticks as the lines a gateway appends: (symbol, value)."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return feeds.ticks(spark, sf).select("event_id", F.to_json(F.struct(
        F.col("symbol").alias("code"), iso.alias("time"), F.col("value").alias("price"), F.col("size").alias("volume"), F.col("event_id").alias("sequence"))).alias("value"))


def _pushed(spark, sf, write, shape=lambda rows: rows):
    """Two runs of one query on one checkpoint: half of the channels are there at first, the others come before the restart."""
    push.register(spark)
    path, checkpoint = fresh_path(spark, "landing"), fresh_path(spark, "landing-checkpoint")
    lines = _push_lines(spark, sf)
    for part in (0, 1):
        lines.where(F.col("event_id") % 2 == part).select("value").repartition(4).write.mode("append").text(path)
        stream = push.parsed(spark.readStream.format("push_feed").option("path", path).option("splitBytes", 1 << 20).load(), TICKER)
        write(shape(stream.drop("channel", "position")).writeStream).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


PUSHED_SQL = "SELECT event_type AS code, ts AS time, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume, event_id AS sequence FROM events"


@query("s13_push_source", PUSHED_SQL)
def _(spark, sf):
    out = fresh_path(spark, "pushed")
    _pushed(spark, sf, lambda w: w.format("parquet").option("path", out))
    return _ntz(spark.read.schema(TICKER).parquet(out), "time")


@query("s14_push_archive", PUSHED_SQL)
def _(spark, sf):
    out = fresh_path(spark, "archive")
    _pushed(spark, sf, lambda w: w.format("push_archive").option("path", out).option("writer", "ticks").option("ts", "time"),
            lambda rows: push.by_hour(rows, "time"))
    return _ntz(push.read_archive(spark, out, TICKER), "time")
