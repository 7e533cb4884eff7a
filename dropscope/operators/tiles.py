"""Calendar tiles for trailing windows: sums of whole UTC months and years.

A window reaches back from now to some second: it is raw rows of open days, days of the open month, months of the open
year, whole years, then the months up to its first whole year and the days up to its first whole month. Each day is
counted by exactly one of a daily row, a month and a year, so totals equal those over daily rows, while a window of
a year reads some 60 daily rows of a key in place of 365.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dropscope.config import DAY, WINDOWS
from dropscope.functions.times import floor_div

TILE_KEY = ["ip", "list_type"]
EPOCH = "1970-01-01"


def tile_start(ts: Column | str, grain: str) -> Column:
    """First second of the UTC month or year of ``ts``, whatever the session time zone."""
    epoch = F.to_date(F.lit(EPOCH))
    day = F.date_add(epoch, floor_div(ts, DAY).cast("int"))
    return F.datediff(F.trunc(day, grain), epoch).cast("long") * DAY


def _floor(ts: int, grain: str) -> int:
    day = datetime.fromtimestamp(ts, UTC)
    return int(datetime(day.year, day.month if grain == "month" else 1, 1, tzinfo=UTC).timestamp())


def _after(ts: int, grain: str) -> int:
    """First start of a month or year later than ``ts``."""
    return _floor(_floor(ts, grain) + (32 if grain == "month" else 367) * DAY, grain)


def tile_sums(daily: DataFrame, edge: int, key: list[str] | None = None) -> DataFrame:
    """``grain, start, *key, count`` of the months and years that end by ``edge``, the second the daily rows end at.

    Days are read once; years add up months.
    """
    key = TILE_KEY if key is None else key
    months = daily.filter(F.col("timestamp") < _floor(edge, "month"))
    months = months.groupBy(tile_start("timestamp", "month").alias("start"), *key).agg(F.sum("count").alias("count"))
    month = F.struct(F.lit("month").alias("grain"), "start")
    year = F.struct(F.lit("year").alias("grain"), tile_start("start", "year").alias("start"))
    both = F.when(F.col("start") < _floor(edge, "year"), F.array(month, year)).otherwise(F.array(month))
    rows = months.select(F.explode(both).alias("tile"), *key, "count")
    return rows.groupBy("tile.grain", "tile.start", *key).agg(F.sum("count").alias("count"))


@dataclass(frozen=True)
class Cover:
    """Which rows of each grain a window takes; ``since`` is the second it begins after, None for all history."""

    since: int | None
    month: int  # whole months end here
    year: int  # whole years end here

    @classmethod
    def of(cls, as_of: int, seconds: int | None, edge: int) -> "Cover":
        return cls(None if seconds is None else as_of - seconds, _floor(edge, "month"), _floor(edge, "year"))

    def raw(self) -> Column:
        return F.lit(True) if self.since is None else F.col("timestamp") > self.since

    def days(self) -> Column:
        tail = F.col("timestamp") >= self.month
        if self.since is None:
            return tail
        return (F.col("timestamp") > self.since) & (tail | (F.col("timestamp") < _after(self.since, "month")))

    def months(self) -> Column:
        tail = F.col("start") >= self.year
        if self.since is None:
            return tail
        return (F.col("start") >= _after(self.since, "month")) & (tail | (F.col("start") < _after(self.since, "year")))

    def years(self) -> Column:
        return F.lit(True) if self.since is None else F.col("start") >= _after(self.since, "year")


def tiled_totals(
    fresh: DataFrame, daily: DataFrame, tiles: DataFrame, as_of: int, edge: int, key: list[str] | None = None
) -> DataFrame:
    """As ``reports.window_totals`` over ``daily`` and ``fresh`` rows: one row per key with its sum in every trailing window.

    Only daily rows and tiles that some window takes are read, by filters on plain columns that reach the scans. The
    parts meet in one shuffle, after partial sums.
    """
    key = TILE_KEY if key is None else key
    covers = {w: Cover.of(as_of, seconds, edge) for w, seconds in WINDOWS.items()}
    parts = []
    for rows, takes in (
        (fresh, Cover.raw),
        (daily, Cover.days),
        (tiles.filter(F.col("grain") == "month"), Cover.months),
        (tiles.filter(F.col("grain") == "year"), Cover.years),
    ):
        needed = F.lit(False)
        for cover in covers.values():
            needed = needed | takes(cover)
        values = [F.when(takes(cover), F.col("count")).alias(w) for w, cover in covers.items()]
        parts.append(rows.filter(needed).select(*key, *values))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter(F.col(key[0]).isNotNull()).groupBy(*key).agg(*[F.sum(w).alias(w) for w in covers])
