"""The market-data shapes as they come out of the given tables.

Each Spark feed has a SQL twin (a list of CTEs) so that a query and its check
start from the same definition.  Bars and the aligned panel are written once
per session to the shared folder and read back, as a bar store would be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tandem.functions.ordered import number_rows, running_sum
from tandem.functions.timeline import bin_start, epoch_seconds
from tandem.operators.asof import asof_align, universe_list
from tandem.operators.clean import drop_null_rows
from tandem.operators.resample import resample_ticks, sequence_key
from tandem.sources.shared import written

RULE = "10 minutes"
HORIZONS = (7, 14, 28)
PRICE_COLS = ["open", "high", "low", "close", "volume", "wap"]

_stored: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Written table of this session; rebuilt when its files are gone."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    df = _stored.get(key)
    if df is not None:
        try:
            df.inputFiles()
            df.take(1)
            return df
        except Exception:
            _stored.pop(key, None)
    _stored[key] = written(build(), name)
    return _stored[key]


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), "ts", "event_id", "value",
                    F.round(F.col("value") * 100).cast("bigint").alias("cents"),
                    F.get_json_object("props", "$.k").cast("bigint").alias("size"))


def price_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks with a random-walk-like price: integer running sum, one division."""
    t = ticks(spark, sf_dir)
    centre = t.groupBy("symbol").agg(F.expr("sum(cents) div count(*)").alias("centre"))
    moved = (t.join(centre, "symbol").withColumn("step", F.col("cents") - F.col("centre"))
             .withColumn("_hour", F.floor(epoch_seconds("ts") / 3600)))
    walked = running_sum(moved, ["symbol"], ["ts", "event_id"], "_hour", "step", "units")
    return walked.select("symbol", "ts", "event_id", "units", "size",
                         (F.lit(1000.0) + F.col("units") / F.lit(100000.0)).alias("price"))


def numbered(bars: DataFrame, slice_secs: int = 86_400) -> DataFrame:
    sliced = bars.withColumn("_slice", F.floor(epoch_seconds("ts") / slice_secs))
    return number_rows(sliced, ["symbol"], ["ts"], "_slice").drop("_slice")


def bars(spark: SparkSession, sf_dir: str, rule: str = RULE) -> DataFrame:
    def build():
        return numbered(resample_ticks(price_path(spark, sf_dir), rule, units="units"))
    return stored(spark, sf_dir, f"bars-{rule.replace(' ', '')}", build)


def panel(spark: SparkSession, sf_dir: str, rule: str = RULE) -> DataFrame:
    """Bars as-of aligned to the first symbol's times, rows with a gap dropped."""
    def build():
        b = bars(spark, sf_dir, rule)
        symbols = universe_list(b)
        aligned = asof_align(b, symbols, symbols[0], PRICE_COLS)
        return numbered(drop_null_rows(aligned, symbols, ["close"]))
    return stored(spark, sf_dir, f"panel-{rule.replace(' ', '')}", build)


def trades(spark: SparkSession, sf_dir: str, symbol: str) -> DataFrame:
    """Prices per unit out of line items; ``symbol`` is p_brand or p_type."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col(symbol).alias("symbol"))
    return (li.join(part, li.l_partkey == part.p_partkey)
            .select("symbol", F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("size"),
                    (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
                    ((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("decimal(12,0)") * 100_000_000
                     + F.round(F.col("l_extendedprice") * 100).cast("decimal(8,0)")).alias("event_id")))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per part type."""
    def build():
        return numbered(resample_ticks(trades(spark, sf_dir, "p_type"), "1 day"), 30 * 86_400)
    return stored(spark, sf_dir, "daily", build)


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars per brand."""
    def build():
        t = trades(spark, sf_dir, "p_brand")
        monday = F.date_trunc("week", F.col("ts")).cast("timestamp_ntz")
        key = sequence_key("ts", "event_id")
        b = (t.withColumn("week", monday).groupBy("symbol", F.col("week").alias("ts"))
             .agg(F.min_by("price", key).alias("open"), F.max("price").alias("high"),
                  F.min("price").alias("low"), F.max_by("price", key).alias("close"),
                  F.sum("size").alias("volume")))
        return numbered(b, 365 * 86_400)
    return stored(spark, sf_dir, "weekly", build)


def quotes(spark: SparkSession, sf_dir: str, as_of: str | None = None, half_spread: float = 0.001) -> DataFrame:
    """Latest quote per symbol at a time (default: the last tick)."""
    p = price_path(spark, sf_dir)
    if as_of is not None:
        p = p.where(F.col("ts") <= F.lit(as_of).cast("timestamp_ntz"))
    last = p.groupBy("symbol").agg(F.max_by("price", sequence_key("ts", "event_id")).alias("LAST"))
    return last.select("symbol", (F.col("LAST") * (1 - half_spread)).alias("BID"),
                       (F.col("LAST") * (1 + half_spread)).alias("ASK"),
                       "LAST", F.col("LAST").alias("CLOSE"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("position_id"), F.col("o_orderpriority").alias("code"),
                    (100 * (1 + F.col("o_orderkey") % 20)).cast("double").alias("qty"),
                    (F.col("o_totalprice") / 1000).alias("cost_price"))


def option_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.withColumn("k", F.explode(F.array(F.lit("c"), F.lit("p")))).select(
        F.concat_ws("-", F.col("p_partkey").cast("string"), F.col("k")).alias("contract"),
        "p_partkey", F.col("k").alias("option_type"), (F.col("p_retailprice") / 10).alias("fs"),
        (F.col("p_retailprice") / 10 * (F.lit(0.8) + F.lit(0.02) * (F.col("p_size") % 20))).alias("x"),
        ((1 + F.col("p_size")) / F.lit(52.0)).alias("t"), F.lit(0.01).alias("r"), F.lit(0.0).alias("q"),
        (F.lit(0.1) + F.lit(0.01) * (F.col("p_partkey") % 40)).alias("v"))


# --- SQL twins -------------------------------------------------------------

TICKS_SQL = """
ticks AS (SELECT event_type AS symbol, ts, event_id, value, CAST(round(value * 100) AS BIGINT) AS cents,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS size FROM events)"""

PATH_SQL = TICKS_SQL + """,
centre AS (SELECT symbol, CAST(sum(cents) AS BIGINT) // count(*) AS centre FROM ticks GROUP BY symbol),
path0 AS (SELECT t.symbol, t.ts, t.event_id, t.size, CAST(sum(t.cents - c.centre) OVER (PARTITION BY t.symbol
  ORDER BY t.ts, t.event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS units
  FROM ticks t JOIN centre c ON t.symbol = c.symbol),
path AS (SELECT *, 1e3 + CAST(units AS DOUBLE) / 1e5 AS price FROM path0)"""


def bars_sql(rule: str = RULE) -> str:
    return PATH_SQL + f""",
bars0 AS (SELECT symbol, time_bucket(INTERVAL '{rule}', ts) AS ts, arg_min(price, ROW(ts, event_id)) AS open,
  max(price) AS high, min(price) AS low, arg_max(price, ROW(ts, event_id)) AS close,
  CAST(sum(size) AS DOUBLE) AS volume,
  CAST(sum(units * size) AS DOUBLE) / nullif(CAST(sum(size) AS DOUBLE) * 1e5, 0) + 1000 AS wap
  FROM path GROUP BY 1, 2),
bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn FROM bars0)"""


def panel_sql(rule: str = RULE) -> str:
    return bars_sql(rule) + """,
anchor AS (SELECT ts, s.symbol FROM (SELECT ts FROM bars WHERE symbol = (SELECT min(symbol) FROM bars)) a,
  (SELECT DISTINCT symbol FROM bars) s),
aligned AS (SELECT a.symbol, a.ts, b.open, b.high, b.low, b.close, b.volume, b.wap
  FROM anchor a ASOF LEFT JOIN bars b ON a.symbol = b.symbol AND a.ts >= b.ts),
whole AS (SELECT ts FROM aligned GROUP BY ts HAVING count(close) = (SELECT count(DISTINCT symbol) FROM bars)),
panel AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn FROM aligned
  WHERE ts IN (SELECT ts FROM whole))"""


def trades_sql(symbol: str) -> str:
    return f"""
trades AS (SELECT {symbol} AS symbol, l_shipdate AS ts, l_quantity AS size, l_extendedprice / l_quantity AS price,
  CAST(l_orderkey * 10 + l_linenumber AS HUGEINT) * 100000000 + CAST(round(l_extendedprice * 100) AS HUGEINT) AS event_id FROM lineitem JOIN part ON l_partkey = p_partkey)"""


DAILY_SQL = trades_sql("p_type") + """,
daily0 AS (SELECT symbol, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, arg_min(price, ROW(ts, event_id)) AS open,
  max(price) AS high, min(price) AS low, arg_max(price, ROW(ts, event_id)) AS close, sum(size) AS volume,
  sum(price * size) / sum(size) AS wap FROM trades GROUP BY 1, 2),
daily AS (SELECT * RENAME (day AS ts), row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS rn FROM daily0)"""

WEEKLY_SQL = trades_sql("p_brand") + """,
weekly0 AS (SELECT symbol, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, arg_min(price, ROW(ts, event_id)) AS open,
  max(price) AS high, min(price) AS low, arg_max(price, ROW(ts, event_id)) AS close, sum(size) AS volume
  FROM trades GROUP BY 1, 2),
weekly AS (SELECT * RENAME (week AS ts), row_number() OVER (PARTITION BY symbol ORDER BY week) - 1 AS rn FROM weekly0)"""

QUOTES_SQL = PATH_SQL + """,
quotes AS (SELECT symbol, last * 0.999e0 AS BID, last * 1.001e0 AS ASK, last AS LAST, last AS CLOSE
  FROM (SELECT symbol, arg_max(price, ROW(ts, event_id)) AS last FROM path GROUP BY symbol))"""

POSITIONS_SQL = """
positions AS (SELECT o_orderkey AS position_id, o_orderpriority AS code,
  CAST(100 * (1 + o_orderkey % 20) AS DOUBLE) AS qty, o_totalprice / 1000 AS cost_price FROM orders)"""

CHAIN_SQL = """
chain AS (SELECT p_partkey || '-' || k AS contract, p_partkey, k AS option_type, p_retailprice / 10 AS fs,
  p_retailprice / 10 * (0.8e0 + 0.02e0 * (p_size % 20)) AS x, (1 + p_size) / 52e0 AS t, 0.01e0 AS r, 0e0 AS q,
  0.1e0 + 0.01e0 * (p_partkey % 40) AS v FROM part, (VALUES ('c'), ('p')) o(k))"""


def with_(ctes: str, body: str = "") -> str:
    return "WITH " + ctes.strip() + "\n" + body.strip()
