"""Bars out of ticks or finer bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tandem.functions.timeline import bin_start, col, epoch_micros, epoch_seconds


def sequence_key(ts: str | Column, tie: str | Column) -> Column:
    """Orderable number for (ts, tie): a fixed-width buffer keeps hash aggregation."""
    micros = epoch_micros(ts).cast("decimal(17,0)")
    return micros * F.lit("1" + "0" * 20).cast("decimal(21,0)") + col(tie).cast("decimal(20,0)")


def resample_ticks(ticks: DataFrame, rule: str, price: str = "price", size: str = "size",
                   tie: str = "event_id", units: str | None = None) -> DataFrame:
    """Open/high/low/close/volume/wap per (symbol, left-closed bin).

    Partial aggregation runs before the shuffle, so a hot symbol costs one row
    per bin and task.
    """
    key = sequence_key("ts", tie)
    if units:  # integer price units keep the weighted price exact
        money = F.sum(F.col(units) * F.col(size)) / F.nullif(F.sum(size) * F.lit(100000.0), F.lit(0.0)) + 1000
    else:
        money = F.sum(F.col(price) * F.col(size)) / F.nullif(F.sum(size), F.lit(0))
    return (ticks.groupBy("symbol", bin_start("ts", rule).alias("ts"))
            .agg(F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
                 F.max_by(price, key).alias("close"), F.sum(size).cast("double").alias("volume"),
                 money.alias("wap")))


def resample_bars(bars: DataFrame, rule: str) -> DataFrame:
    """Coarser bars: first/max/min/last/sum per left-closed bin."""
    key = epoch_micros("ts")
    traded = F.sum(F.when(F.col("wap").isNotNull(), F.col("volume")))
    return (bars.groupBy("symbol", bin_start("ts", rule).alias("ts"))
            .agg(F.min_by("open", key).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
                 F.max_by("close", key).alias("close"), F.sum("volume").alias("volume"),
                 (F.sum(F.col("wap") * F.col("volume")) / F.nullif(traded, F.lit(0.0))).alias("wap")))


def fill_empty_bins(bars: DataFrame, rule_seconds: int) -> DataFrame:
    """Add the bins in which a symbol did not trade, between its first and last bar."""
    span = bars.groupBy("symbol").agg(F.min("ts").alias("_a"), F.max("ts").alias("_z"))
    step = F.make_dt_interval(secs=F.lit(rule_seconds))
    grid = span.select("symbol", F.explode(F.sequence("_a", "_z", step)).alias("ts"))
    return grid.join(bars, ["symbol", "ts"], "left")


def infer_interval(bars: DataFrame) -> DataFrame:
    """Most frequent gap in seconds between neighbouring bars (smallest on ties)."""
    from tandem.functions.ordered import chunked
    from pyspark.sql import Window

    def gaps(d, w):
        return d.withColumn("gap", F.col("_t") - F.lag("_t").over(w))

    timed = bars.withColumn("_t", epoch_seconds("ts"))
    counts = (chunked(timed, ["symbol"], "rn", 1, 0, gaps).where("gap is not null")
              .groupBy("symbol", "gap").agg(F.count(F.lit(1)).alias("n")))
    best = F.max_by("gap", F.struct(F.col("n"), -F.col("gap")))
    return counts.groupBy("symbol").agg(best.alias("interval_secs"))
