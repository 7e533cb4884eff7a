"""Bands, badges and small text forms used by reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dropscope.functions.ip import _col


def risk_band(score: Column | str, high: int = 50) -> Column:
    return F.when(F.coalesce(_col(score), F.lit(0)) >= high, "high").otherwise("low")


def severity_band(delta: Column | str, yellow: int = 20, red: int = 100) -> Column:
    delta = _col(delta)
    return F.when(delta > red, "red").when(delta > yellow, "yellow").otherwise("green")


def list_badge(list_type: Column | str) -> Column:
    return F.when(_col(list_type) == "trap", "TRAP").otherwise("MAIN")


def signed(diff: Column, zero: str = "=0") -> Column:
    """``+n``, ``-n``; no change prints as ``zero``."""
    return (
        F.when(diff > 0, F.concat(F.lit("+"), diff.cast("string")))
        .when(diff < 0, diff.cast("string"))
        .otherwise(F.lit(zero))
    )


def shorten(text: Column, limit: int = 200) -> Column:
    """Texts over ``limit`` characters end in three dots and are exactly ``limit`` long."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def duration_seconds(months=0, weeks=0, days=0, hours=0, minutes=0, seconds=0) -> Column:
    """Length of a ban in seconds; a month is 30 days."""
    factors = ((months, 2592000), (weeks, 604800), (days, 86400), (hours, 3600), (minutes, 60), (seconds, 1))
    total = F.lit(0).cast("long")
    for value, factor in factors:
        total = total + (value if isinstance(value, Column) else F.lit(value)).cast("long") * factor
    return total


def uptime_text(seconds: Column) -> Column:
    """``Nd Nh``."""
    days = F.floor(seconds / 86400)
    hours = F.floor(F.pmod(seconds, F.lit(86400)) / 3600)
    return F.concat(days.cast("string"), F.lit("d "), hours.cast("string"), F.lit("h"))
