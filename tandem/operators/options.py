"""Option-chain jobs: one row per contract or scenario, priced in bulk."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tandem.functions import grids
from tandem.functions.pricing import price_european, reject_reason


def join_chain(contracts: DataFrame, spot: DataFrame, vol: DataFrame, on: str = "symbol") -> DataFrame:
    """Contracts with the current spot and volatility of their underlying."""
    return contracts.join(spot.select(on, "fs"), on).join(vol.select(on, "v"), on)


def validate_chain(chain: DataFrame, model: str = "merton") -> DataFrame:
    """Adds ``reject_reason``; good rows have NULL."""
    return chain.withColumn("reject_reason", reject_reason(model))


def mc_price_chain(chain: DataFrame, paths: int = 500_000, seed: int = 0, key: str = "contract") -> DataFrame:
    """Discounted mean payoff of simulated terminal prices.

    Each path's normal draw is a hash of (contract, path, seed), so a retried
    task draws the same numbers; paths are summed where they arise.
    """
    unit = lambda salt: (F.pmod(F.xxhash64(F.col(key), F.col("_path"), F.lit(seed), F.lit(salt)), F.lit(2 ** 52)) + 0.5) / float(2 ** 52)
    normal = F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * math.pi * unit(2))
    b = F.col("r") - F.col("q")
    v, t = F.col("v"), F.col("t")
    end = F.col("fs") * F.exp((b - v * v / 2) * t + v * F.sqrt(t) * normal)
    side = F.when(F.col("option_type") == "c", 1.0).otherwise(-1.0)
    payoff = F.exp(-F.col("r") * t) * F.greatest(side * (end - F.col("x")), F.lit(0.0))
    rows = chain.withColumn("_path", F.explode(F.sequence(F.lit(1), F.lit(paths))))
    return (rows.withColumn("_pay", payoff).groupBy(key).agg(
        F.avg("_pay").alias("value"), (F.stddev_samp("_pay") / math.sqrt(paths)).alias("std_error")))


def _price(rows: DataFrame, american: bool) -> DataFrame:
    if american:
        from tandem.functions.american import price_american
        return price_american(rows)
    return price_european(rows)


def _told(legs: DataFrame, keys: Sequence[str], values, size: int, steps: bool, summed: bool, spot: str, value: str) -> DataFrame:
    """Grids of structures, whose legs meet by the keys before there is a grid; the legs of one structure make one row."""
    fields = [legs.schema[k] for k in keys]
    whole = legs.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in legs.columns if c not in keys])).alias("_legs"))
    schema = StructType(fields + ([StructField("step", IntegerType())] if steps else [])
                        + list(StructType.fromDDL(grids.SUMMARY if summed else f"point int, {spot} double, {value} double")))
    return whole.mapInArrow(grids.told(list(keys), values, size, steps, summed, schema.names), schema)


def _met(legs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Legs dealt by the keys, to several tasks a core: valuing a grid costs far more than moving its legs."""
    spark = legs.sparkSession
    return legs.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _scenarios(legs: DataFrame, keys: Sequence[str], width: float, points: int, fractions: int, american: bool, summed: bool) -> DataFrame:
    names = ["option_type", "x", "sign", "kept", "stock", "fs", "t", "r", "q", "v"]
    start = _met(legs.select(*keys, *names), keys)
    if not american:
        start = price_european(start).withColumnRenamed("value", "_v0").select(*keys, *names, "_v0")
    values = grids.scenario_values(width, points, fractions, american)
    return _told(start, keys, values, points * fractions * (20 if american else 1), True, summed, "fs", "pnl")


def scenario_grid(legs: DataFrame, keys: Sequence[str], width: float = 0.1, points: int = 200, fractions: int = 4,
                  american: bool = False) -> DataFrame:
    """Profit of option structures over a spot grid and the time left.

    ``legs(keys, option_type, x, sign, kept, stock, fs, t, r, q, v)``: ``sign``
    is +1 bought / -1 sold, ``kept`` the share of the opening premium counted
    on top, ``stock`` the shares held with the leg.
    """
    return _scenarios(legs, keys, width, points, fractions, american, False)


def scenario_summary(legs: DataFrame, keys: Sequence[str], width: float = 0.1, points: int = 200, fractions: int = 4,
                     american: bool = False) -> DataFrame:
    """For each structure and step of its ``scenario_grid``: best and worst outcome, mean, share of points with a profit, and at which spots."""
    return _scenarios(legs, keys, width, points, fractions, american, True)


def premium_curve(chain: DataFrame, by: str, low: Column, high: Column, points: int, american: bool = False) -> DataFrame:
    """Premium of each contract along a grid of ``by`` (strike ``x`` or volatility ``v``)."""
    rows = chain.withColumn("_low", low).withColumn("_high", high).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    rows = rows.withColumn(by, F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("point") / (points - 1)).drop("_low", "_high")
    return _price(rows, american)


def _payoffs(legs: DataFrame, keys: Sequence[str], low: Column, high: Column, points: int, summed: bool) -> DataFrame:
    names = ["option_type", "x", "premium", "delta", "sign", "scale", "stock", "fs"]
    rows = _met(legs.select(*keys, *names, low.alias("_low"), high.alias("_high")), keys)
    return _told(rows, keys, grids.payoff_values(points), points, False, summed, "s", "payoff")


def payoff_grid(legs: DataFrame, keys: Sequence[str], low: Column, high: Column, points: int = 1000) -> DataFrame:
    """Linear payoff of structures with premium and a delta multiplier.

    ``legs(keys, option_type, x, premium, delta, sign, scale, stock, fs)``.
    """
    return _payoffs(legs, keys, low, high, points, False)


def payoff_summary(legs: DataFrame, keys: Sequence[str], low: Column, high: Column, points: int = 1000) -> DataFrame:
    """For each structure of ``payoff_grid``: best and worst outcome, mean, share of points with a profit, and at which spots."""
    return _payoffs(legs, keys, low, high, points, True)


def business_year_fraction(spans: DataFrame, calendar: DataFrame, start: str = "start_day", end: str = "end_day") -> DataFrame:
    """Business days from ``start`` (counted) to ``end`` (not counted) over 252.

    A running count per calendar day turns the range into two equi-joins.
    """
    edge = calendar.agg(F.min("day").alias("_a"), F.max("day").alias("_z"))
    low, high = spans.agg(F.min(start)).scalar(), spans.agg(F.max(end)).scalar()
    every = edge.select(F.explode(F.sequence(F.least(F.col("_a"), low), F.greatest(F.col("_z"), high))).alias("day"))
    w = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    counted = (every.join(calendar.select("day").distinct().withColumn("_open", F.lit(1)), "day", "left")
               .withColumn("_before", F.coalesce(F.sum("_open").over(w), F.lit(0))).select("day", "_before"))
    a = counted.select(F.col("day").alias(start), F.col("_before").alias("_from"))
    z = counted.select(F.col("day").alias(end), F.col("_before").alias("_to"))
    return (spans.join(a, start).join(z, end)
            .withColumn("year_fraction", (F.col("_to") - F.col("_from")) / 252.0).drop("_from", "_to"))


def date_range(as_of: Column, days: int) -> tuple[Column, Column]:
    """[as_of - days, as_of + 1) as date texts."""
    fmt = lambda d: F.date_format(d, "yyyy-MM-dd")
    return fmt(F.date_sub(as_of, days)), fmt(F.date_add(as_of, 1))


def iv_hv_rows(prices: DataFrame, hv: DataFrame, iv: DataFrame) -> DataFrame:
    """Price with the latest historical and implied volatility and their ratio."""
    from tandem.operators.asof import asof_join
    d = asof_join(asof_join(prices, hv, ["symbol"], ["hv"]), iv, ["symbol"], ["iv"])
    return d.where("hv > 0 and iv is not null").withColumn("iv_hv", F.try_divide(F.col("iv"), F.col("hv")))


def iv_hv_report(rows: DataFrame) -> DataFrame:
    """Rank of the implied volatility and of the ratio within the symbol's history.

    ``rows`` are read several times by the quantile steps: hand in a written table.
    """
    from tandem.operators.volatility import nearest_rank, quantile_grid
    d = rows
    for value in ("iv", "iv_hv"):
        grid = quantile_grid(rows, ["symbol"], value).withColumnRenamed("_grid", f"_{value}")
        d = d.join(grid, "symbol").withColumn(f"{value}_rank", nearest_rank(F.col(value), F.col(f"_{value}")))
    return d.drop("_iv", "_iv_hv")
