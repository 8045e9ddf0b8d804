"""Exact linear-interpolated quantiles without one task holding a whole group.

``percentile`` keeps every distinct value of a group in one aggregation buffer.
Here a mergeable sketch first brackets each wanted rank; only the rows inside
the bracket are counted by value and ranked, and equal values collapse before
the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

ACCURACY = 2000
MARGIN = 2.0 / ACCURACY  # twice the sketch's rank error
GRID = 1000


def between(low: Column, high: Column, share: Column) -> Column:
    """low * (1 - share) + high * share, rounded as DuckDB rounds it (one fused product): ranks by distance to a quantile
    tie often on values of two decimals, and the last bit then decides."""
    return F.java_method(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - share, high * share).cast("double")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """One row per key and q: (keys, q, quantile). ``keys`` must not be empty.

    A bracket reaches the margin and two ranks to either side of the wanted rank, so that of a small group is
    the whole of it.
    """
    d = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    sketch = d.groupBy(*keys).agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", [k / GRID for k in range(GRID + 1)], ACCURACY).alias("_grid"))
    reach = F.lit(MARGIN) + F.lit(2.0) / F.col("_n")

    def bracket(q: float):
        lo, hi = F.floor((F.lit(q) - reach) * GRID), F.ceil((F.lit(q) + reach) * GRID)
        return F.struct(F.lit(q).alias("q"), F.when(lo <= 0, F.col("_min")).otherwise(F.get("_grid", lo.cast("int"))).alias("_a"),
                        F.when(hi >= GRID, F.col("_max")).otherwise(F.get("_grid", hi.cast("int"))).alias("_z"))

    wanted = sketch.select(*keys, "_n", F.explode(F.array(*[bracket(float(q)) for q in qs])).alias("_w")).select(*keys, "_n", "_w.*")
    values = d.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    joined = values.join(wanted, list(keys))
    below = joined.groupBy(*keys, "q").agg(
        F.coalesce(F.sum(F.when(F.col("_v") < F.col("_a"), F.col("_c"))), F.lit(0)).alias("_below"))
    inside = joined.where("_v between _a and _z").join(below, [*keys, "q"])
    w = Window.partitionBy(*keys, "q").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    h = F.col("q") * (F.col("_n") - 1)
    ranked = (inside.withColumn("_top", F.sum("_c").over(w) + F.col("_below"))
              .withColumn("_h", h).withColumn("_f", F.floor("_h"))
              .withColumn("_l", F.col("_top") - F.col("_c")))
    hit = lambda r: (F.col("_l") <= r) & (F.col("_top") > r)
    at = ranked.groupBy(*keys, "q").agg(
        F.max(F.when(hit(F.col("_f")), F.col("_v"))).alias("_v0"),
        F.max(F.when(hit(F.least(F.col("_f") + 1, F.col("_n") - 1)), F.col("_v"))).alias("_v1"),
        F.max(F.col("_h") - F.col("_f")).alias("_p"))
    missed = F.col("_v0").isNull() | F.col("_v1").isNull()
    found = F.when(missed, F.raise_error(F.lit("a bracket misses the wanted rank"))).when(F.col("_p") == 0, F.col("_v0")).otherwise(
        between(F.col("_v0"), F.col("_v1"), F.col("_p")))
    return at.select(*keys, "q", found.alias("quantile"))
