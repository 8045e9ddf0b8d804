"""Grouped statistics over bars, trades and call logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tandem.functions.ordered import chunked, range_totals
from tandem.functions.quantiles import exact_quantiles
from tandem.functions.timeline import epoch_micros


def day_extreme_times(bars: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Minute of day at which each day's high and low are first touched.

    A price within float tolerance of the extreme counts as a touch, so the
    extreme is found first and its first touch second; both combine map-side.
    """
    day = F.to_date("ts").alias("day")
    ext = bars.groupBy("symbol", day).agg(F.max("high").alias("_h"), F.min("low").alias("_l"))
    near = lambda v, e: F.abs(F.col(v) - F.col(e)) <= atol + rtol * F.abs(F.col(e))
    minute = F.hour("ts") * 60 + F.minute("ts")
    d = bars.withColumn("day", F.to_date("ts")).join(ext, ["symbol", "day"])
    return d.groupBy("symbol", "day").agg(
        F.min(F.when(near("high", "_h"), minute)).alias("high_minute"),
        F.min(F.when(near("low", "_l"), minute)).alias("low_minute"))


def minute_histogram(times: DataFrame, width: int) -> DataFrame:
    """Days per (symbol, extreme, minute bin)."""
    long = times.select("symbol", F.explode(F.map_from_arrays(
        F.array(F.lit("H"), F.lit("L")), F.array("high_minute", "low_minute"))).alias("extreme", "minute"))
    return (long.groupBy("symbol", "extreme", (F.floor(F.col("minute") / width) * width).alias("minute_bin"))
            .agg(F.count(F.lit(1)).alias("days")))


def price_histogram(bars: DataFrame, bins: int = 100) -> DataFrame:
    """Counts of the OHLC average (3 decimals) in equal-width bins; last edge closed."""
    p = bars.select("symbol", F.round((F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4, 3).alias("p"))
    counted = p.groupBy("symbol", "p").agg(F.count(F.lit(1)).alias("_c"))
    span = counted.groupBy("symbol").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    b = F.least(F.floor(F.try_divide(F.col("p") - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    return (counted.join(span, "symbol").withColumn("bin", F.coalesce(b, F.lit(0)).cast("bigint"))
            .groupBy("symbol", "bin").agg(F.sum("_c").alias("n")))


def describe_series(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """count, mean, std, min, 25 %, 50 %, 75 %, max per key."""
    base = df.groupBy(*keys).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    q = exact_quantiles(df, keys, value, [0.25, 0.5, 0.75])
    wide = q.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == p, F.col("quantile"))).alias(n)
                                  for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    return base.join(wide, list(keys), "left")


def backtest_summary(trades: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, sample deviation and their ratio over trade returns."""
    d = trades.groupBy(*keys).agg(F.avg("rt").alias("mean"), F.stddev_samp("rt").alias("std"),
                                  F.count("rt").alias("trades"))
    return d.withColumn("sharpe", F.try_divide(F.col("mean"), F.col("std")))


def backtest_cube(trades: DataFrame, dims: Sequence[str], value: str = "rt", totals: Sequence[str] = ()) -> DataFrame:
    """``backtest_summary`` for every subset of ``dims``; bit k of ``level``, from the right, is set where ``dims[-1 - k]`` is summed over.

    Trades are aggregated at the finest level first, so that only groups, not trades, are repeated for each subset;
    counts, sums and squared deviations are then merged.  ``totals`` are columns to sum besides.
    """
    n = F.count(value)
    fine = trades.groupBy(*dims).agg(n.alias("_n"), F.sum(value).alias("_s"), (F.var_pop(value) * n).alias("_m"),
                                     *[F.sum(c).alias(f"_t_{c}") for c in totals])
    merged = fine.cube(*dims).agg(
        F.grouping_id().cast("bigint").alias("level"), F.sum("_n").alias("trades"), F.sum("_s").alias("_s"),
        (F.sum("_m") + F.sum(F.try_divide(F.col("_s") * F.col("_s"), F.col("_n")))).alias("_q"),
        *[F.sum(f"_t_{c}").alias(c) for c in totals])
    mean = F.try_divide(F.col("_s"), F.col("trades"))
    spread = F.when(F.col("trades") > 1, F.sqrt(F.greatest(F.col("_q") - mean * F.col("_s"), F.lit(0.0)) / (F.col("trades") - 1)))
    return (merged.withColumns({"mean": mean, "std": spread})
            .withColumn("sharpe", F.when(F.col("std") > 1e-6, F.col("mean") / F.col("std"))).drop("_s", "_q"))


def contract_profit(trades: DataFrame, keys: Sequence[str], name: str = "pair") -> DataFrame:
    """Profit and number of transactions per contract; contracts without profit are left out."""
    return (trades.groupBy(*keys, name).agg(F.sum("profit").alias("profit"), F.count(F.lit(1)).alias("transactions"))
            .where("profit <> 0"))


def scenario_summary(trades: DataFrame, keys: Sequence[str], name: str = "pair") -> DataFrame:
    """Totals over contracts with a profit: count, sum, mean, population deviation; one row more for all."""
    per = contract_profit(trades, keys, name)
    return per.rollup(*keys).agg(
        F.count(F.lit(1)).alias("contracts"), F.sum("profit").alias("total"), F.avg("profit").alias("mean"),
        F.stddev_pop("profit").alias("std"))


def corr_matrix(panel: DataFrame, value: str = "r") -> DataFrame:
    """Pearson correlation of every ordered pair of symbols at common times.

    Only n1 < n2 is joined; the other half is mirrored from the result.
    """
    a = panel.select(F.col("symbol").alias("a"), "ts", F.col(value).alias("_x"))
    b = panel.select(F.col("symbol").alias("b"), "ts", F.col(value).alias("_y"))
    half = a.join(b, "ts").where("a <= b").groupBy("a", "b").agg(F.corr("_x", "_y").alias("corr"))
    mirrored = half.where("a < b").select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")
    return half.unionByName(mirrored)


def lagged_corr(panel: DataFrame, bars_per_day: int, days: Sequence[int], value: str = "r") -> DataFrame:
    """Correlation of symbol a's return k days ahead with symbol c's present return.

    The future returns of one symbol are attached to its own rows first, so the
    pair join carries one row per (a, c, ts) and not one per k.
    """
    top = max(days) * bars_per_day

    def build(d, w):
        return d.withColumns({f"_f{k}": F.lead(value, k * bars_per_day).over(w) for k in days})

    ahead = chunked(panel, ["symbol"], "rn", 0, top, build)
    a = ahead.select(F.col("symbol").alias("a"), "ts", *[f"_f{k}" for k in days])
    c = panel.select(F.col("symbol").alias("c"), "ts", F.col(value).alias("_x"))
    wide = a.join(c, "ts").groupBy("a", "c").agg(*[F.corr(f"_f{k}", "_x").alias(f"_c{k}") for k in days])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_c{k}").alias("corr")) for k in days]))
    return wide.select("a", "c", rows.alias("_r")).select("a", "c", "_r.*")


def top_n_correlated(corr: DataFrame, column: str, others: Sequence[str], n: int = 10, least: bool = False,
                     floor: float | None = None) -> DataFrame:
    """Per column the n entries of largest (or least) absolute correlation."""
    strength = F.abs("corr")
    order = [strength.asc() if least else strength.desc(), *others]
    w = Window.partitionBy(column).orderBy(*order)
    top = corr.where("corr is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return top.where(strength >= floor) if floor is not None else top


def top_n_json(top: DataFrame, column: str, others: Sequence[str]) -> DataFrame:
    """One JSON text per column: ranked labels (at most n of them, bounded by the top-n)."""
    label = F.concat_ws(" ", *[F.col(o).cast("string") for o in others])
    ranked = F.array_sort(F.collect_list(F.struct("rank", label.alias("label"))))
    return top.groupBy(column).agg(ranked.alias("_l")).select(
        column, F.to_json(F.transform("_l", lambda s: s["label"])).alias("top"))


def money_coeff(models: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Geometric mean of the extreme std rates."""
    return models.groupBy(*keys).agg(F.sqrt(F.max("std_rate") * F.min("std_rate")).alias("coeff"))


# Fixed request limits: window seconds and calls allowed in it.
GLOBAL_SPAN, GLOBAL_CALLS = 600, 60
SAME_CALL_SPAN, SAME_CALL_CALLS = 1, 1
SAME_CALL_SYMBOL_SPAN, SAME_CALL_SYMBOL_CALLS = 2, 6


def call_rate_audit(calls: DataFrame, global_span: int = GLOBAL_SPAN, global_calls: int = GLOBAL_CALLS,
                    call_span: int = SAME_CALL_SPAN, call_calls: int = SAME_CALL_CALLS,
                    symbol_span: int = SAME_CALL_SYMBOL_SPAN,
                    symbol_calls: int = SAME_CALL_SYMBOL_CALLS) -> DataFrame:
    """Earlier calls inside each window before a call, and whether it was allowed.

    Windows are cut into time chunks with copied borders, so the one over the
    whole log runs in as many tasks as there are chunks.
    """
    us = 1_000_000

    def counted(df, keys, span, out):
        return range_totals(df, keys, "_us", span * us, {"n": F.lit(1)}, lambda t: {out: t["n"]}, size=max(60, span) * us)

    d = calls.withColumn("_us", epoch_micros("ts"))
    d = counted(d, [], global_span, "_total")
    d = counted(d, ["call_name"], call_span, "_same")
    d = counted(d, ["call_name", "symbol"], symbol_span, "_pair")
    total, same, pair = (F.col(c) - 1 for c in ("_total", "_same", "_pair"))
    return d.select(*calls.columns, total.alias("calls_total"), same.alias("calls_same"), pair.alias("calls_same_symbol"),
                    ((total < global_calls) & (same < call_calls) & (pair < symbol_calls)).alias("allowed"))
