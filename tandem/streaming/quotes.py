"""Operators on quote, bar and order-book streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tandem.functions.timeline import col
from tandem.operators import pairs as pr

QUOTE_FIELDS = ("BID", "ASK", "LAST", "CLOSE")


def latest_quote(quotes: DataFrame, tie: str | Column = "ts") -> DataFrame:
    """Latest price of every field per symbol: one row per symbol.

    A native streaming aggregate; its state is one row per symbol.  Works on a
    batch as well.
    """
    newest = lambda f: F.max_by("price", F.when(F.col("field") == f, col(tie))).alias(f)
    return quotes.groupBy("symbol").agg(*[newest(f) for f in QUOTE_FIELDS])


def watch_handler(models: DataFrame, threshold: float = 1.8, limit: int = 50):
    """Batch handler: every refresh starts from the full pair table."""
    return lambda quotes, batch_id: pr.watch_pairs(models, quotes, threshold, limit)


def position_handler(positions: DataFrame, models: DataFrame):
    return lambda quotes, batch_id: pr.watch_positions(positions, quotes, models)


def stream_pair_join(bars: DataFrame, models: DataFrame, delay: str = "1 hour") -> DataFrame:
    """z of both legs' bars of the same time, as they arrive in either order."""
    x = (bars.withWatermark("ts", delay).select(F.col("symbol").alias("n1"), F.col("ts").alias("x_ts"), F.col("close").alias("x"))
         .join(models, "n1"))
    y = bars.withWatermark("ts", delay).select(F.col("symbol").alias("y_symbol"), F.col("ts").alias("y_ts"), F.col("close").alias("y"))
    both = x.join(y, F.expr("n2 = y_symbol AND x_ts = y_ts"))
    z = F.try_divide(F.col("s") * F.col("x") + F.col("i") - F.col("y") - F.col("m"), F.col("st"))
    return both.select("pair", F.col("x_ts").alias("ts"), "x", "y", z.alias("z"))


def stream_bars(ticks: DataFrame, rule: str, delay: str = "10 minutes", order: str | Column = "ts") -> DataFrame:
    """Tumbling bars of a tick stream; a bin closes once the watermark passes it, later rows are dropped."""
    w = F.window("ts", rule)
    return (ticks.withWatermark("ts", delay).groupBy("symbol", w)
            .agg(F.min_by("price", col(order)).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
                 F.max_by("price", col(order)).alias("close"), F.sum("size").cast("double").alias("volume"))
            .select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume"))


def dedup_stream(bars: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop bars delivered again within the watermark delay."""
    return bars.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "ts"])


def book_top(books: DataFrame) -> DataFrame:
    """Best prices, spread, mid and depth of order-book rows.

    ``Ask`` and ``Bid`` are arrays of (price, volume, order_num, orders) from
    the best level on; works on streams and batches.
    """
    best = lambda side, f: F.try_element_at(side, F.lit(1))[f]
    depth = lambda side: F.aggregate(side, F.lit(0).cast("bigint"), lambda a, l: a + l["volume"])
    ask, bid = best("Ask", "price"), best("Bid", "price")
    return books.withColumns({
        "best_ask": ask, "best_bid": bid, "spread": ask - bid, "mid": (ask + bid) / 2, "ask_volume": best("Ask", "volume"),
        "bid_volume": best("Bid", "volume"), "ask_depth": depth("Ask"), "bid_depth": depth("Bid"),
        "levels": F.greatest(F.size("Ask"), F.size("Bid"))}).drop("Ask", "Bid")
