"""Cleaning, slicing and filtering of bar tables and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tandem.functions.timeline import col, minus_days


def wide_to_long(wide: DataFrame, fields: Sequence[str] | None = None, ts: str = "ts") -> DataFrame:
    """Columns ``field_SYMBOL`` -> one row per (symbol, ts)."""
    values = [c for c in wide.columns if c != ts]
    long = wide.unpivot([ts], values, "_name", "_value")
    split = long.select(ts, F.regexp_extract("_name", r"^[^_]+_(.*)$", 1).alias("symbol"),
                        F.regexp_extract("_name", r"^([^_]+)_", 1).alias("_field"), "_value")
    fields = list(fields or sorted({c.split("_", 1)[0] for c in values}))
    return split.groupBy("symbol", ts).pivot("_field", fields).agg(F.max("_value"))


def long_to_wide(bars: DataFrame, symbols: Sequence[str], fields: Sequence[str], ts: str = "ts") -> DataFrame:
    """One row per time with columns ``field_SYMBOL`` for an explicit universe."""
    aggs = [F.max(F.when(F.col("symbol") == s, F.col(f))).alias(f"{f}_{s}") for s in symbols for f in fields]
    return bars.groupBy(ts).agg(*aggs)


def drop_null_rows(bars: DataFrame, symbols: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Keep times at which every symbol has every column."""
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull()
    full = (bars.groupBy("ts").agg(F.count(F.when(whole, 1)).alias("_n"))
            .where(F.col("_n") == len(symbols)).select("ts"))
    return bars.join(full, "ts", "left_semi")


def drop_incomplete_symbols(bars: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep symbols that have a complete bar at every time of the table."""
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull()
    per_symbol = bars.groupBy("symbol").agg(F.count(F.when(whole, 1)).alias("_n"))
    times = bars.agg(F.count_distinct("ts"))
    keep = per_symbol.where(F.col("_n") == times.scalar()).select("symbol")
    return bars.join(keep, "symbol", "left_semi")


def dedup_bars(bars: DataFrame, order: str | Column) -> DataFrame:
    """First bar per (symbol, ts) in file order, by aggregation (combines map-side)."""
    rest = [c for c in bars.columns if c not in ("symbol", "ts")]
    first = F.min_by(F.struct(*rest), col(order))
    return bars.groupBy("symbol", "ts").agg(first.alias("_b")).select("symbol", "ts", "_b.*")


def clean_returns(value: str | Column) -> Column:
    v = col(value)
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(0.0)).otherwise(v)


def slice_until(bars: DataFrame, end_date: str) -> DataFrame:
    """Rows up to and including the whole day ``end_date``."""
    end = F.date_add(F.lit(end_date).cast("date"), 1).cast("timestamp_ntz")
    return bars.where(F.col("ts") < end)


def trailing(bars: DataFrame, days: int) -> DataFrame:
    """Rows of the last ``days`` calendar days before the latest time, inclusive."""
    last = bars.agg(F.max("ts"))
    return bars.where(F.col("ts") >= minus_days(last.scalar(), days))


def tail(bars: DataFrame, n: int, rn: str = "rn") -> DataFrame:
    """Last ``n`` rows of each symbol, by the row number the bar table carries."""
    sizes = bars.groupBy("symbol").agg((F.max(rn) + 1 - F.lit(n)).alias("_from"))
    return bars.join(sizes, "symbol").where(F.col(rn) >= F.col("_from")).drop("_from")


def assert_span(bars: DataFrame, days: int) -> DataFrame:
    """Pass the table through, or fail when it does not span more than ``days``."""
    span = bars.agg(F.min("ts").alias("_a"), F.max("ts").alias("_z"))
    ok = minus_days("_z", days) > F.col("_a")
    checked = span.select(F.when(ok, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"bars span no more than {days} days")).cast("boolean")))
    return bars.where(checked.scalar())


def trading_days(bars: DataFrame) -> DataFrame:
    return bars.select(F.to_date("ts").alias("day")).distinct()


def _with_calendar(days: DataFrame, models: DataFrame, value: str) -> DataFrame:
    """For each model date the first ``value`` on a calendar day at or after it.

    Works on one row per day, so the unpartitioned window stays calendar-sized.
    """
    marks = days.select("day", value).unionByName(
        models.select(F.col("model_date").alias("day"), "model_date").distinct(), allowMissingColumns=True)
    w = Window.partitionBy(F.lit(0)).orderBy("day").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    return marks.withColumn(value, F.min(value).over(w)).where("model_date is not null").select("model_date", value)


def test_window(bars: DataFrame, models: DataFrame, next_open: bool = False) -> DataFrame:
    """Rows of the trading day after each ``model_date`` (second day at or after it).

    With ``next_open`` the first bar of the day after is added, at which a
    position that is still open gets closed.
    """
    days = bars.groupBy(F.to_date("ts").alias("day")).agg(F.min("ts").alias("_open"))
    cal = Window.partitionBy(F.lit(0)).orderBy("day")
    nexts = days.select("day", F.lead("day").over(cal).alias("second"))
    second = _with_calendar(nexts, models, "second").where("second is not null")
    opens = days.select(F.col("day").alias("second"), F.lead("_open").over(cal).alias("next_open_ts"))
    second = second.join(opens, "second")
    day_rows = bars.withColumn("second", F.to_date("ts")).join(second, "second").drop("second", "next_open_ts")
    if not next_open:
        return day_rows
    following = (bars.join(second.select("model_date", F.col("next_open_ts").alias("ts")).where("ts is not null"), "ts")
                 .select(*day_rows.columns))
    return day_rows.unionByName(following)


def bt_range(bars: DataFrame, models: DataFrame, days: float = 1.5, session_hours: float = 6.5) -> DataFrame:
    """Start and end of the test range per ``model_date``.

    The range starts at the first bar at or after 23:59:59 of the model day.
    """
    late = F.col("ts") >= F.to_date("ts").cast("timestamp_ntz") + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")
    firsts = bars.groupBy(F.to_date("ts").alias("day")).agg(
        F.min("ts").alias("_first"), F.min(F.when(late, F.col("ts"))).alias("_late"))
    following = F.lead("_first").over(Window.partitionBy(F.lit(0)).orderBy("day"))
    starts = firsts.withColumn("_next", F.least(F.col("_late"), following)).select("day", "_next", "_first")
    # A model date without bars starts at the first bar of the next day with bars.
    exact = models.select("model_date").distinct().join(
        starts.select(F.col("day").alias("model_date"), F.col("_next").alias("_exact"), F.lit(1).alias("_has")),
        "model_date", "left")
    ahead = _with_calendar(starts.select("day", "_first"), models, "_first")
    secs = int(days * session_hours * 3600)
    start = F.when(F.col("_has") == 1, F.col("_exact")).otherwise(F.col("_first"))
    return (exact.join(ahead, "model_date").select("model_date", start.alias("start_ts")).where("start_ts is not null")
            .withColumn("end_ts", F.col("start_ts") + F.make_dt_interval(secs=F.lit(secs))))


def trading_dates(bars: DataFrame, skip_days: int = 28) -> DataFrame:
    """Day after each trading day, once ``skip_days`` have passed since the first bar."""
    first = bars.agg(F.min("ts"))
    late = bars.where(minus_days("ts", skip_days) >= first.scalar())
    return late.select(F.date_add(F.to_date("ts"), 1).alias("model_date")).distinct()


def calendar_chain(bars: DataFrame) -> DataFrame:
    """Each trading day with the one before it (the calendar is one row per day)."""
    w = Window.partitionBy(F.lit(0)).orderBy("day")
    return trading_days(bars).withColumn("prev_day", F.lag("day").over(w))


def filter_pairs(pairs: DataFrame, include: DataFrame | None = None,
                 exclude: DataFrame | None = None, available: DataFrame | None = None) -> DataFrame:
    """Both legs in ``include``; else neither in ``exclude``; both legs with data."""
    def legs(df, other, how):
        for leg in ("n1", "n2"):
            df = df.join(other.select(F.col("symbol").alias(leg)), leg, how)
        return df
    if include is not None:
        pairs = legs(pairs, include, "left_semi")
    elif exclude is not None:
        pairs = legs(pairs, exclude, "left_anti")
    return legs(pairs, available, "left_semi") if available is not None else pairs


# Fixed thresholds of the model filters.
MAX_SLOPE_DIFF_RATE = 0.3
MIN_HALFLIFE_SECS = 34 * 60
MAX_PVALUE = 0.1
V0_MAX_HURST = 0.45
V0_MAX_HALFLIFE_SECS = 6 * 3600
OLS_MIN_SLOPE = 0.05
JS_MIN_PRICE = 5.0
JS_MIN_SLOPE = 0.01


def v1_slope() -> Column:
    """Slope a v1 model trades with; NULL when the model is not usable."""
    rate = F.abs(F.try_divide(F.col("s_0") - F.col("s_dayslr"), F.col("s_dayslr")))
    secs = F.floor(F.col("hl_bars_0") * F.col("interval_secs"))
    ok = ((rate <= MAX_SLOPE_DIFF_RATE) & (secs >= MIN_HALFLIFE_SECS)
          & (F.col("pxy") <= MAX_PVALUE) & (F.col("pyx") <= MAX_PVALUE) & (F.col("s_dayslr") != 0))
    return F.when(ok, F.col("s_dayslr"))


def filter_models_v1(models: DataFrame) -> DataFrame:
    return models.withColumn("slope", v1_slope()).where("slope is not null")


def filter_models_v0(models: DataFrame) -> DataFrame:
    return models.where((F.col("HE") <= V0_MAX_HURST) & (F.col("halflife_secs") <= V0_MAX_HALFLIFE_SECS))


def filter_models_ols(models: DataFrame) -> DataFrame:
    return models.where(F.col("s") > OLS_MIN_SLOPE).drop("start_of_pmin")


def filter_models_js(models: DataFrame, max_hurst: float = 0.49, max_halflife_hours: float = 6.5,
                     ignored: Sequence[str] = ()) -> DataFrame:
    hours = F.col("hl_bars_0") * F.col("interval_secs") / 3600.0
    ok = ((F.col("x_last") >= JS_MIN_PRICE) & (F.col("y_last") >= JS_MIN_PRICE)
          & (F.col("he_0") <= max_hurst) & (hours > 0) & (hours <= max_halflife_hours))
    for s in ("s_0", "s_dayslr", "s_daysfast", "s_hllr", "s_hlfast"):
        ok = ok & (F.col(s) >= JS_MIN_SLOPE)
    if ignored:
        ok = ok & ~F.col("n1").isin(*ignored) & ~F.col("n2").isin(*ignored)
    return models.where(ok)


def valid_snapshots(quotes: DataFrame, min_price: float = 3.0, max_spread: float | None = None) -> DataFrame:
    ok = (F.col("BID") > min_price) & (F.col("ASK") > min_price) & (F.col("LAST") > min_price)
    if max_spread is not None:
        ok = ok & (F.abs(F.col("BID") - F.col("ASK")) / F.col("ASK") <= max_spread)
    return quotes.where(ok)


def parse_money(text: str | Column) -> Column:
    return F.regexp_replace(F.trim(col(text)), r"[$,]", "").cast("double")


def parse_date(text: str | Column, fmt: str) -> Column:
    return F.to_timestamp_ntz(F.trim(col(text)), F.lit(fmt))


def recent_insiders(insiders: DataFrame, as_of: str, days: int, min_value: float = 150_000,
                    min_cost: float = 10) -> DataFrame:
    since = minus_days(F.lit(as_of).cast("timestamp_ntz"), days)
    return (insiders.where((F.col("dt") >= since) & (F.col("value") >= min_value) & (F.col("cost") > min_cost))
            .orderBy(F.desc("dt"), F.desc("value")))


def pair_split(pairs: DataFrame, pair: str = "pair") -> DataFrame:
    return (pairs.withColumn("n1", F.split(F.col(pair), "_")[0])
            .withColumn("n2", F.split(F.col(pair), "_")[1]))


def pair_arg() -> Column:
    """Plot-command argument string of a pair row."""
    return F.concat_ws(" ", "n1", "n2", F.lit("-s"), F.col("s").cast("string"), F.lit("-m"),
                       F.col("m").cast("string"), F.lit("--st"), F.col("st").cast("string"),
                       F.lit("-i"), F.col("i").cast("string"))


def adjust_prices(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Forward-adjusted close = raw * A + B of the factor period that holds the bar.

    ``factors(symbol, ex_ts, a, b)``; a bar before ``ex_ts`` takes the factors of
    the next ex-date, one at or after the last ex-date stays as it is.
    """
    from tandem.operators.asof import asof_join
    from tandem.functions.timeline import epoch_seconds
    w = Window.partitionBy("symbol").orderBy("ex_ts")
    starts = factors.withColumn("ts", F.col("ex_ts")).withColumn("_a", F.lead("a").over(w)).withColumn(
        "_b", F.lead("b").over(w)).select("symbol", "ts", "_a", "_b", F.lit(1).alias("_seen"))
    first = factors.groupBy("symbol").agg(F.min_by("a", "ex_ts").alias("_fa"), F.min_by("b", "ex_ts").alias("_fb"))
    got = asof_join(bars, starts, ["symbol"], ["_a", "_b", "_seen"]).join(first, "symbol", "left")
    before = F.col("_seen").isNull()
    a = F.coalesce(F.when(before, F.col("_fa")).otherwise(F.col("_a")), F.lit(1.0))
    b = F.coalesce(F.when(before, F.col("_fb")).otherwise(F.col("_b")), F.lit(0.0))
    return got.withColumn("adj_close", F.col("close") * a + b).drop("_a", "_b", "_seen", "_fa", "_fb")
