"""Symbol pairs by the latest z of their fitted line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tandem.operators.pairs import all_pair_bars
from tandem.operators.resample import resample_ticks
from tandem.plans import feeds
from tandem.plans.registry import query


def latest_pair_z(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    bars = resample_ticks(feeds.price_path(spark, sf_dir), rule, units="units")
    both = all_pair_bars(bars, ["close"])
    x, y = F.col("x_close"), F.col("y_close")
    fit = both.groupBy("n1", "n2").agg(
        F.count(F.lit(1)).alias("bars"), F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("i"),
        F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"),
        F.max_by(x, "ts").alias("_x"), F.max_by(y, "ts").alias("_y"))
    st = F.sqrt(F.greatest(F.col("_syy") - F.col("s") * F.col("_sxy"), F.lit(0.0)) / (F.col("bars") - 1))
    z = (F.col("_x") * F.col("s") + F.col("i") - F.col("_y")) / F.col("st")
    return (fit.withColumn("st", st).where("st > 0").withColumn("z", z)
            .select(F.concat_ws("_", "n1", "n2").alias("pair"), "bars", F.round("s", 6).alias("s"),
                    F.round("i", 4).alias("i"), F.round("st", 6).alias("st"), F.round("z", 5).alias("z"))
            .orderBy(F.desc(F.abs("z")), "pair"))


@query("flagship_latest_pair_z", feeds.with_(feeds.bars_sql(), """
, fit AS (SELECT a.symbol || '_' || b.symbol AS pair, count(*) AS bars, regr_slope(b.close, a.close) AS s,
  regr_intercept(b.close, a.close) AS i, arg_max(a.close, a.ts) AS x, arg_max(b.close, a.ts) AS y
  FROM bars a JOIN bars b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY 1),
res AS (SELECT f.pair, stddev_samp(a.close * f.s + f.i - b.close) AS st FROM fit f
  JOIN bars a ON true JOIN bars b ON a.ts = b.ts AND a.symbol || '_' || b.symbol = f.pair GROUP BY 1)
SELECT f.pair, bars, round(s, 6) AS s, round(i, 4) AS i, round(st, 6) AS st,
  round((x * s + i - y) / st, 5) AS z FROM fit f JOIN res r ON f.pair = r.pair"""))
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_pair_z(spark, sf_dir, feeds.RULE)
