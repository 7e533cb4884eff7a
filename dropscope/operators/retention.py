"""Ageing of history: daily roll-up, protected sources, deletion, details clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dropscope.config import DAY
from dropscope.functions import ip as IP
from dropscope.functions.times import day_floor
from dropscope.operators.reports import top_n_per

NOON = 43200


def closed_day(as_of: int) -> int:
    """First second of the day the trailing 24 hours begin in: only whole days before it are rolled up."""
    return (as_of - DAY) // DAY * DAY


def rollup(facts: DataFrame, key: list[str], as_of: int) -> DataFrame:
    """One row per closed UTC day and key, stamped noon; days rolled up before stay as they are."""
    old = facts.filter(F.col("timestamp") < closed_day(as_of))
    noon = (day_floor(F.col("timestamp")) + NOON).alias("timestamp")
    return old.groupBy(noon, *key).agg(F.sum("count").alias("count"))


def rollup_drops(drops: DataFrame, as_of: int) -> DataFrame:
    """Daily tier: one row per closed UTC day and list, stamped noon."""
    return rollup(drops, ["list_name"], as_of)


def rollup_ip_drops(ip_drops: DataFrame, as_of: int) -> DataFrame:
    """Daily tier per address and list type."""
    return rollup(ip_drops, ["ip", "list_type"], as_of)


def compact(facts: DataFrame, key: list[str], as_of: int) -> DataFrame:
    """Daily tier plus the raw rows of days that are still open."""
    fresh = facts.filter(F.col("timestamp") >= closed_day(as_of)).select("timestamp", *key, "count")
    return rollup(facts, key, as_of).select("timestamp", *key, "count").unionByName(fresh)


def vip_ips(ip_drops: DataFrame, as_of: int, n: int = 15) -> DataFrame:
    """Sources protected from deletion: top ``n`` of all time, of a year and of 30 days. At most 3n rows."""
    since = lambda s: F.sum(F.when(F.col("timestamp") >= as_of - s, F.col("count")))
    sums = ip_drops.groupBy("ip").agg(
        F.sum("count").alias("all"), since(365 * DAY).alias("1y"), since(30 * DAY).alias("30d")
    )
    rows = sums.unpivot(["ip"], ["all", "1y", "30d"], "window", "total").filter(F.col("total").isNotNull())
    return top_n_per(rows, ["window"], "total", ["ip"], n).select("ip").distinct()


def not_vip(ip_drops: DataFrame, vip: DataFrame) -> DataFrame:
    """Rows of unprotected sources. A cut list as ``vip`` is small enough for Spark to broadcast by measured size."""
    return ip_drops.join(vip, "ip", "left_anti")


def retain_ip_drops(ip_drops: DataFrame, vip: DataFrame, as_of: int) -> DataFrame:
    """History kept: no row of at most 5 hits after 30 days, after 45 days only protected sources."""
    flagged = ip_drops.join(vip.select("ip", F.lit(True).alias("_vip")), "ip", "left")
    ts = F.col("timestamp")
    faint = (ts < as_of - 30 * DAY) & (F.col("count") <= 5)
    stale = (ts < as_of - 45 * DAY) & F.col("_vip").isNull()
    return flagged.filter(~faint & ~stale).select(*ip_drops.columns)


def prune_ip_info(ip_info: DataFrame, ip_drops: DataFrame) -> DataFrame:
    """Details of sources that still have facts (compared without the prefix)."""
    live = ip_drops.select(IP.strip_prefix("ip").alias("ip")).distinct()
    return ip_info.join(live, "ip", "left_semi")
