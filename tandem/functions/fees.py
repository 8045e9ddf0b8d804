"""Brokerage and regulatory fees as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed fee values, per share or as a share of the amount.
US_PLATFORM_V0 = (0.01, 1.99)
US_COMMISSION_V1, US_PLATFORM_V1 = (0.005, 1.0), (0.0049, 0.99)
US_COMMISSION_V2, US_PLATFORM_V2 = (0.01, 1.0), (0.0049, 0.99)
US_CLEARING = 0.003
US_SEC = (0.0000051, 0.01)
US_ACTIVITY = (0.000119, 0.01, 5.95)
HK_PLATFORM, HK_COMMISSION = 20.0, (0.0003, 3.0)
HK_SYSTEM = 0.5
HK_CLEARING = (0.00002, 2.0, 100.0)
HK_TRADING = (0.00005, 0.01)
HK_LEVY = (0.000027, 0.01)
HK_STAMP_BEFORE_AUG_2021, HK_STAMP_AFTER = 0.001, 0.0013


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        x = F.greatest(x, F.lit(low))
    return F.least(x, F.lit(high)) if high is not None else x


def us_commission(quantity: Column, plan: str = "v0") -> Column:
    at_least = lambda rate: clip(quantity * rate[0], rate[1])
    if plan == "v0":
        return at_least(US_PLATFORM_V0)
    if plan == "v1":
        return at_least(US_COMMISSION_V1) + at_least(US_PLATFORM_V1)
    return at_least(US_COMMISSION_V2) + at_least(US_PLATFORM_V2)


def us_regulatory(quantity: Column, price: Column, sell: Column) -> Column:
    selling = clip(quantity * price * US_SEC[0], US_SEC[1]) + clip(quantity * US_ACTIVITY[0], *US_ACTIVITY[1:])
    return quantity * US_CLEARING + F.when(sell, selling).otherwise(0.0)


def us_fee(quantity: Column, price: Column, sell: Column) -> Column:
    return us_regulatory(quantity, price, sell) + us_commission(quantity)


def hk_commission(amount: Column) -> Column:
    return HK_PLATFORM + clip(amount * HK_COMMISSION[0], HK_COMMISSION[1])


def hk_regulatory(quantity: Column, price: Column, stamp_rate: float = HK_STAMP_BEFORE_AUG_2021) -> Column:
    a = quantity * price
    return (HK_SYSTEM + clip(a * HK_CLEARING[0], *HK_CLEARING[1:]) + F.ceil(a * stamp_rate)
            + clip(a * HK_TRADING[0], HK_TRADING[1]) + clip(a * HK_LEVY[0], HK_LEVY[1]))


def hk_fee(quantity: Column, price: Column, stamp_rate: float = HK_STAMP_BEFORE_AUG_2021) -> Column:
    return hk_regulatory(quantity, price, stamp_rate) + hk_commission(quantity * price)


def breakeven(positions: DataFrame, fee: Column) -> DataFrame:
    """Fee of a round trip (shown doubled) and the lowest price without a loss."""
    both = fee * 2
    return positions.withColumns({"fee": both * 2, "low_price": F.try_divide(both, F.col("qty")) + F.col("cost_price")})
