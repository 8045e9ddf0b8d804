"""Distribution of forward returns: normal and Laplace fits and their tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tandem.functions.ordered import running_sum
from tandem.functions.pricing import let, norm_cdf
from tandem.functions.quantiles import exact_quantiles
from tandem.sources.shared import written

VALUE_SLICES = 4096


def laplace_cdf(x: Column, loc: Column, scale: Column) -> Column:
    z = F.try_divide(x - loc, scale)
    return F.when(z < 0, F.exp(z) / 2).otherwise(1 - F.exp(-z) / 2)


def _skew_z(skew: Column, n: Column) -> Column:
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta - 1))
    delta, alpha = 1 / F.sqrt(0.5 * F.log(w2)), F.sqrt(2 / (w2 - 1))
    return delta * F.asinh(y / alpha)


def _kurtosis_z(excess: Column, n: Column) -> Column:
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (excess + 3 - mean) / F.sqrt(var)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    denominator = 1 + x * F.sqrt(2 / (a - 4))
    term = F.signum(denominator) * F.cbrt((1 - 2 / a) / F.abs(denominator))
    return (1 - 2 / (9 * a) - term) / F.sqrt(2 / (9 * a))


def fit_returns(rows: DataFrame, key: str = "symbol") -> DataFrame:
    """Moments, normal and Laplace fits per key of ``rows(key, r)``."""
    stats = rows.groupBy(key).agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"),
                                  F.skewness("r").alias("skew"), F.kurtosis("r").alias("kurtosis"),
                                  F.min("r").alias("low"), F.max("r").alias("high"))
    median = exact_quantiles(rows, [key], "r", [0.5]).select(key, F.col("quantile").alias("loc"))
    spread = rows.join(median, key).groupBy(key).agg(
        F.first("loc").alias("loc"), F.avg(F.abs(F.col("r") - F.col("loc"))).alias("scale"))
    return stats.join(spread, key)


def fit_tests(rows: DataFrame, fits: DataFrame, key: str = "symbol") -> DataFrame:
    """Kolmogorov-Smirnov distances of both fits and the K-squared normality test.

    Ranks come from value counts cut into value slices, so no key is sorted whole.
    """
    counts = rows.groupBy(key, "r").agg(F.count(F.lit(1)).alias("_c")).join(fits, key)
    part = F.floor(F.try_divide(F.col("r") - F.col("low"), F.col("high") - F.col("low")) * VALUE_SLICES)
    ranked = running_sum(counts.withColumn("_slice", F.coalesce(part, F.lit(0))), [key], ["r"], "_slice", "_c", "_cum")
    ranked = ranked.withColumn("_z", F.try_divide(F.col("r") - F.col("mean"), F.col("std")))
    above, below = F.col("_cum") / F.col("n"), (F.col("_cum") - F.col("_c")) / F.col("n")
    gap = lambda cdf: F.max(let(cdf, lambda f: F.greatest(above - f, f - below)))
    ks = ranked.groupBy(key).agg(gap(norm_cdf(F.col("_z"))).alias("ks_normal"),
                                 gap(laplace_cdf(F.col("r"), F.col("loc"), F.col("scale"))).alias("ks_laplace"))
    n = F.col("n").cast("double")
    d = fits.join(ks, key).withColumns({"_zs": _skew_z(F.col("skew"), n), "_zk": _kurtosis_z(F.col("kurtosis"), n)})
    d = d.withColumn("k2", F.col("_zs") * F.col("_zs") + F.col("_zk") * F.col("_zk"))
    return d.withColumn("p_normal", F.exp(-F.col("k2") / 2)).drop("low", "high", "_zs", "_zk")


def return_distribution(returns: DataFrame, key: str = "symbol", value: str = "r") -> DataFrame:
    """Fits and tests of the returns of each key; a missing return counts as the mean.

    The rows and the fits are read by several later steps, so both are written
    to the shared folder first.
    """
    mean = returns.groupBy(key).agg(F.avg(value).alias("_u"))
    rows = written(returns.select(key, value).join(mean, key).select(key, F.coalesce(value, "_u").alias("r")), "returns")
    return fit_tests(rows, written(fit_returns(rows, key), "fits"), key)
