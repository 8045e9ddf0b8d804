"""Pair enumeration, pair-level joins, watch lists and screens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Symbols of a block of a group whose pairs are enumerated.
BLOCK = 512


def enumerate_pairs(universe: DataFrame, group: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """All n1 < n2 inside a group: the N(N-1)/2 candidates.

    A group's symbols are dealt to blocks of about ``block``, and each block meets each other one and itself once:
    however large a group is, a join key has at most about ``block`` squared pairs, and the join stays an equi-join.
    """
    one = universe.select(*group, "symbol").distinct()
    if not group:
        one = one.withColumn("_g", F.lit(0))
    keys = list(group) or ["_g"]
    blocks = one.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("_blocks"))
    dealt = one.join(blocks, keys).withColumn("_own", F.pmod(F.xxhash64("symbol"), F.col("_blocks")))
    # a pair of blocks has the lesser first, so that a pair of symbols meets once, in either order
    others = lambda low, high: F.explode(F.sequence(low.cast("bigint"), high.cast("bigint"))).alias("_other")
    left = dealt.select(*keys, F.col("symbol").alias("_a"), F.col("_own").alias("_i"), others(F.col("_own"), F.col("_blocks") - 1)).withColumnRenamed("_other", "_j")
    right = dealt.select(*keys, F.col("symbol").alias("_b"), F.col("_own").alias("_j"), others(F.lit(0), F.col("_own"))).withColumnRenamed("_other", "_i")
    if group:  # many pairs come from few rows, so sizes of the input say nothing about the tasks wanted
        spark = universe.sparkSession
        tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        left, right = (d.repartition(tasks, *keys, "_i", "_j") for d in (left, right))
    met = left.join(right, [*keys, "_i", "_j"]).where("_i < _j AND _a <> _b OR _i = _j AND _a < _b")
    pairs = met.select(*group, F.least("_a", "_b").alias("n1"), F.greatest("_a", "_b").alias("n2"))
    return pairs.select(*group, F.concat_ws("_", "n1", "n2").alias("pair"), "n1", "n2")


def pair_bars(pairs: DataFrame, bars: DataFrame, cols: Sequence[str] = ("close",)) -> DataFrame:
    """Bars of both legs at their common times: x_<col>, y_<col>.

    Legs (those of some pair only) meet by time, an even key, and the pair table picks the pairs: no leg's whole
    history is repeated for each of its partners.
    """
    legs = lambda p, n: (bars.select(F.col("symbol").alias(n), "ts", *[F.col(c).alias(f"{p}_{c}") for c in cols])
                         .join(pairs.select(n).distinct(), n, "left_semi"))
    return legs("x", "n1").join(legs("y", "n2"), "ts").join(pairs, ["n1", "n2"])


def all_pair_bars(panel: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All n1 < n2 of a panel at each common time (equi-join on ts)."""
    x = panel.select(F.col("symbol").alias("n1"), "ts", *[F.col(c).alias(f"x_{c}") for c in cols])
    y = panel.select(F.col("symbol").alias("n2"), "ts", *[F.col(c).alias(f"y_{c}") for c in cols])
    return x.join(y, "ts").where("n1 < n2")


def _leg_quotes(models: DataFrame, quotes: DataFrame) -> DataFrame:
    for n in ("n1", "n2"):
        leg = quotes.select(F.col("symbol").alias(n), F.col("BID").alias(f"bid_{n}"),
                            F.col("ASK").alias(f"ask_{n}"), F.col("LAST").alias(f"last_{n}"))
        models = models.join(leg, n)
    return models


def watch_pairs(models: DataFrame, quotes: DataFrame, threshold: float = 1.8, limit: int = 50) -> DataFrame:
    """Pairs whose tradable z is outside the threshold, the widest bands last.

    z1: sell the first leg at bid, buy the second at ask; z2: the reverse.
    """
    d = _leg_quotes(models.where("s > 0"), quotes)
    s, i, m, st = (F.col(c) for c in ("s", "i", "m", "st"))
    safe = F.nullif(st, F.lit(0.0))
    d = (d.withColumn("z1", (F.col("bid_n1") * s + i - F.col("ask_n2") - m) / safe)
         .withColumn("z2", (F.col("ask_n1") * s + i - F.col("bid_n2") - m) / safe)
         .withColumn("y_per_x", 1 / s)
         .withColumn("st_price_pct", 100 * st / F.greatest("last_n1", "last_n2")))
    hits = d.where((F.col("z1") > threshold) | (F.col("z2") < -threshold))
    top = hits.orderBy(F.desc("st_price_pct"), "pair").limit(limit)
    return top.select("pair", "z1", "z2", "st_price_pct", "y_per_x").orderBy("st_price_pct")


def watch_mark(models: DataFrame, quotes: DataFrame, threshold: float = 1.8) -> DataFrame:
    """Variant on the last price: |z| of the mark outside the threshold."""
    d = _leg_quotes(models, quotes)
    z = (F.col("last_n1") * F.col("s") + F.col("i") - F.col("last_n2") - F.col("m")) / F.nullif(F.col("st"), F.lit(0.0))
    return d.withColumn("z", z).where(F.abs("z") > threshold).select("pair", "z")


def watch_positions(positions: DataFrame, quotes: DataFrame, models: DataFrame) -> DataFrame:
    """Spread z of every pair of which both legs are held (at least one share)."""
    held = (positions.where(F.abs("position") >= 1).join(quotes.select("symbol", F.col("LAST").alias("price")), "symbol")
            .select("symbol", "position", "price"))
    for n, p in (("n1", "x"), ("n2", "y")):
        models = models.join(held.select(F.col("symbol").alias(n), F.col("position").alias(f"{p}_pos"),
                                         F.col("price").alias(f"{p}_price")), n)
    z = (F.col("x_price") * F.col("s") + F.col("i") - F.col("y_price") - F.col("m")) / F.nullif(F.col("st"), F.lit(0.0))
    return models.select("pair", "n1", "n2", "st", "x_price", "x_pos", "y_price", "y_pos", z.alias("z_diff"))


def insider_vs_market(insiders: DataFrame, quotes: DataFrame) -> DataFrame:
    """Left join of quotes with mark and close against the insider's cost."""
    q = quotes.select(F.col("symbol").alias("ticker"), F.col("LAST").alias("mark"), F.col("CLOSE").alias("close"))
    return (insiders.join(q, "ticker", "left")
            .withColumn("mark_cost_pct", pct_vs_cost("mark", "cost"))
            .withColumn("close_cost_pct", pct_vs_cost("close", "cost")))


def pct_vs_cost(mark: str, cost: str) -> Column:
    return F.try_divide(F.col(mark) - F.col(cost), F.col(cost)) * 100


def shared_plates(pairs: DataFrame, stocks: DataFrame, plate_names: DataFrame) -> DataFrame:
    """``name1-name2-plate,plate`` for each pair: the plates both stocks belong to.

    ``stocks(symbol, stock_name, plates MAP)``; ``plate_names(code, name)``.
    """
    d = pairs
    for n in ("n1", "n2"):
        d = d.join(stocks.select(F.col("symbol").alias(n), F.col("stock_name").alias(f"name_{n}"),
                                 F.map_keys("plates").alias(f"plates_{n}")), n, "left")
    common = F.array_intersect(F.coalesce("plates_n1", F.array().cast("array<string>")),
                               F.coalesce("plates_n2", F.array().cast("array<string>")))
    d = d.withColumn("_codes", common)
    named = (d.select("pair", F.explode("_codes").alias("code")).join(plate_names, "code")
             .groupBy("pair").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("_plates")))
    ext = F.concat_ws("-", F.coalesce("name_n1", F.lit("")), F.coalesce("name_n2", F.lit("")),
                      F.coalesce("_plates", F.lit("")))
    return d.join(named, "pair", "left").select("pair", ext.alias("ext"))


def screen_universe(screener: DataFrame, top_volume: int, top_cap: int, min_price: float = 5.0) -> DataFrame:
    """Top by dollar volume, kept when also in the top by market cap."""
    d = (screener.where(F.col("price") > min_price)
         .withColumn("volume_dollar", F.col("price") * F.col("volume")))
    caps = d.orderBy(F.desc("market_cap"), "symbol").limit(top_cap).select("symbol")
    return d.orderBy(F.desc("volume_dollar"), "symbol").limit(top_volume).join(caps, "symbol", "left_semi")


def attach_models(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """Regression results beside their candidates, by pair key."""
    return candidates.join(results, "pair")


def missing_symbols(universe: DataFrame, bars: DataFrame) -> DataFrame:
    return universe.select("symbol").distinct().join(bars.select("symbol").distinct(), "symbol", "left_anti")


def symbol_union(*tables: DataFrame) -> DataFrame:
    """Distinct symbols over bar tables and both legs of pair tables."""
    parts = []
    for t in tables:
        parts += [t.select(F.col(c).alias("symbol")) for c in ("symbol", "n1", "n2") if c in t.columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def concat_bars(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def merge_big_tables(base: DataFrame, daily: DataFrame, symbols: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Concat, drop rows with a gap per source, first duplicate wins, drop gappy symbols.

    The merged bars are counted twice before the last filter, so they are written first.
    """
    from tandem.operators import clean
    from tandem.sources.shared import written
    parts = [clean.drop_null_rows(t, symbols, cols).withColumn("_src", F.lit(k))
             for k, t in enumerate((base, daily))]
    merged = written(clean.dedup_bars(concat_bars(*parts), "_src").drop("_src"), "merged")
    return clean.drop_incomplete_symbols(merged, cols)
