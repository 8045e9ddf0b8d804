"""Time expressions. Bar times are exchange-local, so they stay TIMESTAMP_NTZ."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def epoch_micros(ts: str | Column) -> Column:
    """Microseconds since 1970-01-01 of a zone-free timestamp."""
    return F.timestamp_diff("MICROSECOND", ntz("1970-01-01 00:00:00"), col(ts))


def epoch_seconds(ts: str | Column) -> Column:
    return F.timestamp_diff("SECOND", ntz("1970-01-01 00:00:00"), col(ts))


def bin_start(ts: str | Column, rule: str) -> Column:
    """Left edge of the left-closed bin that holds ``ts``."""
    return F.window(col(ts), rule).getField("start")


def minus_days(ts: str | Column, days: int | Column) -> Column:
    n = F.lit(days) if isinstance(days, int) else days
    return col(ts) - F.make_dt_interval(n)


def strip_tz(text: str | Column) -> Column:
    """Wall-clock time of an ISO string, whatever UTC offset it carries."""
    bare = F.regexp_replace(col(text), r"(Z|[+-]\d{2}:?\d{2})$", "")
    return F.to_timestamp_ntz(bare)


def ib_time(text: str | Column) -> Column:
    """Parse ``yyyyMMdd  HH:mm:ss`` with any run of blanks in the middle."""
    return F.to_timestamp_ntz(F.regexp_replace(F.trim(col(text)), r"\s+", " "), F.lit("yyyyMMdd HH:mm:ss"))


def format_ib_time(ts: str | Column) -> Column:
    return F.date_format(col(ts), "yyyyMMdd  HH:mm:ss")
