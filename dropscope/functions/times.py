"""Epoch-second expressions and time labels (labels use the session time zone)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label pattern per grain.
GRAINS = {"hourly": "HH':00'", "daily": "dd-MM-yyyy", "monthly": "MM-yyyy", "yearly": "yyyy"}


def floor_div(value: Column | str, n: int) -> Column:
    """Whole number of ``n`` at or below ``value``, in integer arithmetic."""
    value = F.col(value) if isinstance(value, str) else value
    return F.call_function("div", value - F.pmod(value, F.lit(n)), F.lit(n))


def bucket_label(ts: Column, grain: str) -> Column:
    return F.date_format(F.timestamp_seconds(ts), GRAINS[grain])


def series_start(grain: str, as_of: int) -> Column | None:
    """First epoch second a series looks at; None = all history."""
    if grain == "hourly":
        return F.lit(as_of - 86400)
    if grain == "daily":
        return F.lit(as_of - 30 * 86400)
    if grain == "monthly":
        now = F.timestamp_seconds(F.lit(as_of))
        return F.unix_timestamp(now - F.expr("INTERVAL 12 MONTHS"))
    return None


def day_floor(ts: Column) -> Column:
    return (ts - F.pmod(ts, F.lit(86400))).cast("long")


def _prune(df: DataFrame, start: int) -> DataFrame:
    """Partition filter for stored facts, which carry ``event_date`` or ``event_month``."""
    first = F.to_date(F.timestamp_seconds(F.lit(start - 86400)))
    if "event_date" in df.columns:
        return df.filter(F.col("event_date") >= first)
    if "event_month" in df.columns:
        return df.filter(F.col("event_month") >= F.to_date(F.trunc(first, "month")))
    return df


def in_window(df: DataFrame, as_of: int, seconds: int | None, ts: str = "timestamp") -> DataFrame:
    """Rows strictly newer than ``as_of - seconds``; None keeps all."""
    if seconds is None:
        return df
    return _prune(df, as_of - seconds).filter(F.col(ts) > F.lit(as_of - seconds))
