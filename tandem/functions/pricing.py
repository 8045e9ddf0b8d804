"""Option values as column expressions (generalised Black-Scholes)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# Fixed coefficients of the 1968 rational approximation of the normal distribution, by descending power.
HART_TOP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
            221.213596169931, 220.206867912376)
HART_BOTTOM = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
               637.333633378831, 793.826512519948, 440.413735824752)
HART_SPLIT, HART_END, ROOT_TWO_PI = 7.07106781186547, 37.0, 2.506628274631

# Fixed limits of valid inputs.
MAX_PRICE = 2147483248.0
LIMITS = {"x": (0.01, MAX_PRICE), "fs": (0.01, MAX_PRICE), "t": (0.001, 100.0), "b": (-1.0, 1.0), "r": (-1.0, 1.0),
          "v": (0.005, 1.0)}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside one expression."""
    return F.transform(F.array(value), use)[0]


def _poly(coefficients, y: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * y + c
    return out


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution function; pass a plain column or a let-bound value."""
    y = F.abs(x)
    bell = F.exp(-y * y / 2)
    far = bell / (ROOT_TWO_PI * (y + 1 / (y + 2 / (y + 3 / (y + 4 / (y + 0.65))))))
    tail = (F.when(y < HART_SPLIT, bell * _poly(HART_TOP, y) / _poly(HART_BOTTOM, y))
            .when(y <= HART_END, far).otherwise(0.0))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


# Cost of carry by model.
CARRY = {"black_scholes": lambda: F.col("r"), "merton": lambda: F.col("r") - F.col("q"), "black_76": lambda: F.lit(0.0),
         "garman_kohlhagen": lambda: F.col("r") - F.col("rf")}


def price_european(chain: DataFrame, model: str = "merton") -> DataFrame:
    """value, delta, gamma, theta, vega, rho of rows (option_type, fs, x, t, r, v, ...)."""
    d = chain.withColumn("_b", CARRY[model]()).withColumn("_side", F.when(F.col("option_type") == "c", 1.0).otherwise(-1.0))
    fs, x, t, r, v, b, side = (F.col(c) for c in ("fs", "x", "t", "r", "v", "_b", "_side"))
    d = d.withColumn("_d1", (F.log(fs / x) + (b + v * v / 2) * t) / (v * F.sqrt(t)))
    d = d.withColumn("_d2", F.col("_d1") - v * F.sqrt(t))
    d = d.withColumns({"_u1": side * F.col("_d1"), "_u2": side * F.col("_d2")})
    d = d.withColumns({"_n1": norm_cdf(F.col("_u1")), "_n2": norm_cdf(F.col("_u2")), "_p1": norm_pdf(F.col("_d1")),
                       "_carry": F.exp((b - r) * t), "_disc": F.exp(-r * t)})
    n1, n2, p1, carry, disc = (F.col(c) for c in ("_n1", "_n2", "_p1", "_carry", "_disc"))
    d = d.withColumns({
        "value": side * (fs * carry * n1 - x * disc * n2),
        "delta": side * carry * n1,
        "gamma": carry * p1 / (fs * v * F.sqrt(t)),
        "theta": -(fs * v * carry * p1) / (2 * F.sqrt(t)) - side * (b - r) * fs * carry * n1 - side * r * x * disc * n2,
        "vega": carry * fs * F.sqrt(t) * p1,
        "rho": side * x * t * disc * n2})
    return d.drop("_b", "_side", "_d1", "_d2", "_u1", "_u2", "_n1", "_n2", "_p1", "_carry", "_disc")


def european_value(side: Column, fs: Column, x: Column, t: Column, r: Column, b: Column, v: Column) -> Column:
    """Value only, as one self-contained expression (for use inside lambdas)."""
    wide = v * F.sqrt(t)
    d1 = (F.log(fs / x) + (b + v * v / 2) * t) / wide
    return let(F.struct((side * d1).alias("a"), (side * (d1 - wide)).alias("b")), lambda u: side * (
        fs * F.exp((b - r) * t) * norm_cdf(u["a"]) - x * F.exp(-r * t) * norm_cdf(u["b"])))


def reject_reason(model: str = "merton") -> Column:
    """First limit a contract row breaks, NULL for a good row."""
    reason = F.when(~F.coalesce("option_type", F.lit("")).isin("c", "p"), "option_type")
    for name, (low, high) in LIMITS.items():
        c = CARRY[model]() if name == "b" else F.col(name)
        reason = reason.when(c.isNull() | (c < low) | (c > high), name)
    return reason


def implied_vol_european(chain: DataFrame, price: str = "price", model: str = "merton", steps: int = 40,
                         precision: float = 1e-5) -> DataFrame:
    """Volatility that reproduces ``price``: bisection over the allowed range; NULL when none does."""
    side = F.when(F.col("option_type") == "c", 1.0).otherwise(-1.0)
    low, high = LIMITS["v"]
    args = [F.col(c) for c in ("fs", "x", "t", "r")]

    def value(v):
        return european_value(side, args[0], args[1], args[2], args[3], CARRY[model](), v)

    def halve(acc, _):
        return let((acc["lo"] + acc["hi"]) / 2, lambda mid: let(value(mid) < F.col(price), lambda under: F.struct(
            F.when(under, mid).otherwise(acc["lo"]).alias("lo"), F.when(under, acc["hi"]).otherwise(mid).alias("hi"))))

    ends = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), ends, halve)
    d = chain.withColumn("_f", found).withColumn("_v", (F.col("_f.lo") + F.col("_f.hi")) / 2)
    ok = F.abs(value(F.col("_v")) - F.col(price)) < precision
    return d.withColumn("iv", F.when(ok, F.col("_v"))).drop("_f", "_v")


def price_asian(chain: DataFrame) -> DataFrame:
    """Average-price option on a forward: averaging from ``t_a`` to ``t`` becomes an adjusted volatility."""
    v2, t, ta = F.col("v") * F.col("v"), F.col("t"), F.col("t_a")
    span = t - ta
    m = (2 * F.exp(v2 * t) - 2 * F.exp(v2 * ta) * (1 + v2 * span)) / (v2 * v2 * span * span)
    adjusted = F.when(ta == t, F.col("v")).otherwise(F.sqrt(F.log(m) / t))
    d = chain.withColumns({"_v": F.col("v"), "v": adjusted})
    return price_european(d, "black_76").withColumn("v", F.col("_v")).drop("_v")


def price_spread_option(chain: DataFrame) -> DataFrame:
    """Option on the difference of two forwards f1, f2 (ratio approximation)."""
    base = F.col("f2") + F.col("x")
    share = F.col("f2") / base
    v = F.sqrt(F.col("v1") * F.col("v1") + F.pow(F.col("v2") * share, 2) - 2 * F.col("corr") * F.col("v1") * F.col("v2") * share)
    d = chain.withColumns({"_x": F.col("x"), "_base": base, "fs": F.col("f1") / base, "v": v}).withColumn("x", F.lit(1.0))
    d = price_european(d, "black_76")
    return d.withColumns({"value": F.col("value") * F.col("_base"), "x": F.col("_x")}).drop(
        "_x", "_base", "fs", "v", "delta", "gamma", "theta", "vega", "rho")
