"""Time series, averages and top lists over the fact tables.

Sums combine on the map side, so an address holding a third of all rows costs one partial row per
task. Top-n lists rank with ``row_number`` under a constant limit, which Spark also applies before
the shuffle (WindowGroupLimit), so no group is ever moved whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dropscope.config import WINDOWS
from dropscope.functions import ip as IP
from dropscope.functions import ports as P
from dropscope.functions.text import list_badge, risk_band
from dropscope.functions.times import _prune, bucket_label, floor_div, series_start

# The columns of a series and the lists each one adds up.
SERIES_COLUMNS = {
    "main": ["FirewallBlock"],
    "v6": ["FirewallBlock6"],
    "vpn": ["VPNBlock"],
    "trap": ["AutoBan", "AutoBan6"],
    "geo": ["GeoBlock", "GeoBlock6"],
}
QUARTER = 900


def top_n(df: DataFrame, by: str, tie: list[str], n: int = 10) -> DataFrame:
    """The ``n`` largest rows; ties go to the smaller key."""
    return df.orderBy(F.col(by).desc(), *[F.col(t) for t in tie]).limit(n)


def top_n_per(df: DataFrame, group: list[str], by: str, tie: list[str], n: int) -> DataFrame:
    w = W.partitionBy(*group).orderBy(F.col(by).desc(), *[F.col(t) for t in tie])
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def _window_sum(as_of: int, seconds: int | None, value: str = "count") -> Column:
    if seconds is None:
        return F.sum(value)
    return F.sum(F.when(F.col("timestamp") > as_of - seconds, F.col(value)))


def lifetime_drops(drops: DataFrame) -> DataFrame:
    return drops.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))


def condense(drops: DataFrame, as_of: int) -> DataFrame:
    """Lossless summary for all series of one ``as_of``: rows per quarter hour, list and series membership.

    A quarter hour never straddles a time-zone label, and the membership flags are part of the key,
    so every series over the summary equals the series over the raw rows.
    """
    flags = []
    for grain in ("hourly", "daily", "monthly"):
        flags.append((F.col("timestamp") >= series_start(grain, as_of)).alias(f"_{grain}"))
    slot = floor_div("timestamp", QUARTER).alias("_slot")
    out = drops.groupBy(slot, "list_name", *flags).agg(
        F.sum("count").alias("count"), F.max("timestamp").alias("timestamp")
    )
    return out.select("timestamp", "list_name", "count")


def _series_rows(drops: DataFrame, grain: str, as_of: int) -> DataFrame:
    start = series_start(grain, as_of)
    if start is None:
        return drops
    back = {"hourly": 86400, "daily": 30 * 86400, "monthly": 366 * 86400}[grain]
    return _prune(drops, as_of - back).filter(F.col("timestamp") >= start)


def _series_aggs(value: str = "count") -> list[Column]:
    cols = []
    for name, lists in SERIES_COLUMNS.items():
        hit = F.when(F.col("list_name").isin(lists), F.col(value)).otherwise(0)
        cols.append(F.sum(hit).alias(name))
    return cols + [F.sum(value).alias("total")]


def _by_label(rows: DataFrame, grain: str) -> DataFrame:
    """Sums per time label. Rows are first summed per quarter hour, an integer key, so text labels are
    only formatted for one row per slot."""
    slots = rows.groupBy(floor_div("timestamp", QUARTER).alias("_slot")).agg(
        *_series_aggs(), F.max("timestamp").alias("newest")
    )
    again = [F.sum(c).alias(c) for c in [*SERIES_COLUMNS, "total"]]
    return slots.groupBy(bucket_label(F.col("newest"), grain).alias("label")).agg(
        *again, F.max("newest").alias("newest")
    )


def drop_series(drops: DataFrame, grain: str, as_of: int) -> DataFrame:
    """Drops per time label; ``newest`` is the label's latest second and gives the display order."""
    return _by_label(_series_rows(drops, grain, as_of), grain)


def series_hourly_ts(drops: DataFrame, as_of: int) -> DataFrame:
    """Hourly series on the true hour, so the first and the current hour of a day stay apart."""
    hour = (F.col("timestamp") - F.pmod(F.col("timestamp"), F.lit(3600))).cast("long")
    return _series_rows(drops, "hourly", as_of).groupBy(hour.alias("hour_ts")).agg(*_series_aggs())


def order_series(series: DataFrame) -> DataFrame:
    """Newest label first, by time and not by text."""
    return series.orderBy(F.col("newest").desc(), "label")


def top_days(drops: DataFrame, n: int = 10) -> DataFrame:
    return top_n(_by_label(drops, "daily"), "total", ["label"], n)


def avg_per_bucket(drops: DataFrame, grain: str, as_of: int) -> DataFrame:
    """Mean of the bucket sums, rounded half to even; buckets without rows do not count."""
    sums = drop_series(drops, grain, as_of).select("total")
    mean = F.coalesce(F.avg("total"), F.lit(0.0))
    return sums.agg(F.bround(mean, 0).cast("long").alias("average")).select(F.lit(grain).alias("grain"), "average")


def window_totals(ip_drops: DataFrame, as_of: int) -> DataFrame:
    """One scan, one shuffle: a row per (ip, list_type) with its sum in every trailing window."""
    sums = [_window_sum(as_of, s).alias(w) for w, s in WINDOWS.items()]
    return ip_drops.filter(F.col("ip").isNotNull()).groupBy("ip", "list_type").agg(*sums)


def _long_form(totals: DataFrame, keep: list[str]) -> DataFrame:
    return totals.unpivot(keep, list(WINDOWS), "window", "total").filter(F.col("total").isNotNull())


def long_totals(totals: DataFrame) -> DataFrame:
    """``ip, list_type, window, total`` of the windows that a key has rows in."""
    return _long_form(totals, ["ip", "list_type"])


def top_ips(ip_drops: DataFrame, as_of: int, n: int = 10, totals: DataFrame | None = None) -> DataFrame:
    """All 20 tables at once: ``family, window, rank, ip, total, list_type``."""
    totals = window_totals(ip_drops, as_of) if totals is None else totals
    kind = (
        F.when(F.col("list_type") == "trap", "trap")
        .when((F.col("list_type") == "main") & IP.is_net("ip"), "nets")
        .when(F.col("list_type") == "main", "hosts")
        .when(F.col("list_type") == "geo", "geo")
    )
    families = F.array_compact(F.array(kind, F.when(IP.is_v6("ip"), F.lit("ipv6"))))
    # The outer form and the null test after it keep the scan below identical for every user of the totals.
    rows = totals.withColumn("family", F.explode_outer(families)).filter(F.col("family").isNotNull())
    rows = _long_form(rows, ["family", "ip", "list_type"])
    per_ip = rows.groupBy("family", "window", "ip").agg(
        F.sum("total").alias("total"), F.max("list_type").alias("list_type")
    )
    # list_type decides no tie; naming it keeps the aggregate whole where only some columns are read.
    return top_n_per(per_ip, ["family", "window"], "total", ["ip", "list_type"], n)


def top_ips_enriched(ip_drops: DataFrame, ip_info: DataFrame, where: Column | None = None, n: int = 10) -> DataFrame:
    """Top sources of a selection with their known details: aggregate and cut first, join ``n`` rows after."""
    rows = ip_drops if where is None else ip_drops.filter(where)
    per_ip = rows.groupBy("ip").agg(F.sum("count").alias("total"), F.max("list_type").alias("list_type"))
    # list_type decides no tie; naming it lets both uses of the list share one scan and shuffle.
    top = top_n(per_ip, "total", ["ip", "list_type"], n).withColumn("info_ip", IP.strip_prefix("ip"))
    return attach_info(top, ip_info, n)


def attach_info(top: DataFrame, ip_info: DataFrame, n: int) -> DataFrame:
    """Details for at most ``n`` rows per table: the cut list is the broadcast side, the dimension is only scanned."""
    info = ip_info.select(F.col("ip").alias("_ip"), "country", "risk", "domain", "target_port", "port_history")
    wanted = F.broadcast(top.select(F.col("info_ip").alias("_ip")).distinct())  # at most n rows
    known = info.join(wanted, "_ip", "left_semi")
    return (
        top.join(known, F.col("info_ip") == F.col("_ip"), "left")
        .drop("_ip", "info_ip")
        .withColumn("risk", F.coalesce("risk", F.lit(0)))
        .withColumn("risk_band", risk_band("risk"))
        .withColumn("badge", list_badge("list_type"))
    )


def attach_port(ip_drops: DataFrame, ip_info: DataFrame) -> DataFrame:
    """Facts with the details of the very same address text; networks have none and fall out."""
    info = ip_info.select("ip", "target_port", "port_history")
    return ip_drops.join(info, "ip", "inner")


def port_totals(totals: DataFrame, ip_info: DataFrame) -> DataFrame:
    """One row per address and window with its port label, from ``window_totals``.

    Facts are summed before the join, so its key is unique on the details side and nearly so on the other.
    """
    info = ip_info.filter(F.col("target_port") > 0)
    rows = _long_form(totals, ["ip", "list_type"]).groupBy("ip", "window").agg(F.sum("total").alias("total"))
    return attach_port(rows, info).withColumn("full_port", P.port_label("target_port", "port_history"))


def _port_tables(per_ip: DataFrame, n: int, shown: int) -> DataFrame:
    """Top ports per window; the shown addresses are the ``shown`` smallest, never the whole group."""
    ranked = top_n_per(
        per_ip.groupBy("window", "full_port").agg(F.count("*").alias("ips"), F.sum("total").alias("total")),
        ["window"],
        "total",
        ["full_port"],
        n,
    )
    pick = W.partitionBy("window", "full_port").orderBy("ip")
    some = (
        per_ip.select("window", "full_port", "ip")
        .withColumn("_r", F.row_number().over(pick))
        .filter(F.col("_r") <= shown)
        .groupBy("window", "full_port")
        .agg(F.array_join(F.array_sort(F.collect_list("ip")), ", ").alias("preview"))
    )
    more = F.greatest(F.col("ips") - shown, F.lit(0))
    return ranked.join(some, ["window", "full_port"], "left").select(
        "window", "rank", "full_port", "ips", "total", "preview", more.alias("more")
    )


def port_stats(
    ip_drops: DataFrame, ip_info: DataFrame, as_of: int, n: int = 10, shown: int = 3, totals: DataFrame | None = None
) -> DataFrame:
    """Top ports for every window: distinct addresses, hits, a short list of addresses."""
    totals = window_totals(ip_drops, as_of) if totals is None else totals
    return _port_tables(port_totals(totals, ip_info), n, shown)


def honeypot_filter(df: DataFrame, tcp: tuple[int, ...], udp: tuple[int, ...]) -> DataFrame:
    """Rows whose port is a configured service over the protocol seen; nothing configured, nothing kept."""
    return df.filter(P.service_match("target_port", "port_history", tcp, udp))


def bruteforce_stats(
    ip_drops: DataFrame,
    ip_info: DataFrame,
    tcp: tuple[int, ...],
    udp: tuple[int, ...],
    as_of: int,
    n: int = 10,
    totals: DataFrame | None = None,
) -> DataFrame:
    """Port tables restricted to trap hits on service ports."""
    trap = F.col("list_type") == "trap"
    if totals is None:
        totals = window_totals(ip_drops.filter(trap), as_of)
    return _port_tables(port_totals(totals.filter(trap), honeypot_filter(ip_info, tcp, udp)), n, 3)


def port_ip_lists(ip_drops: DataFrame, ip_info: DataFrame, as_of: int, n: int = 10) -> DataFrame:
    """Full address list of every reported port: ``window, port, proto, ip``."""
    per_ip = port_totals(window_totals(ip_drops, as_of), ip_info)
    tables = per_ip.groupBy("window", "full_port").agg(F.sum("total").alias("total"))
    # At most n rows per window.
    reported = F.broadcast(top_n_per(tables, ["window"], "total", ["full_port"], n).select("window", "full_port"))
    return per_ip.join(reported, ["window", "full_port"], "left_semi").select(
        "window",
        F.substring_index("full_port", "/", 1).alias("port"),
        F.when(F.col("full_port").contains("/"), F.substring_index("full_port", "/", -1)).otherwise("any").alias("proto"),
        "ip",
    )


def live_top5(baseline: DataFrame, current: DataFrame, ip_info: DataFrame, n: int = 5) -> DataFrame:
    """Largest increases since the session began, with country and severity."""
    from dropscope.functions.text import severity_band
    from dropscope.operators.deltas import snapshot_delta

    top = top_n(snapshot_delta(baseline, current), "delta", ["ip"], n)
    return with_country(top, ip_info).withColumn("severity", severity_band("delta"))


def with_country(top: DataFrame, ip_info: DataFrame) -> DataFrame:
    """Country of a short list of addresses, ``--`` when unknown. ``top`` must be a cut list."""
    keyed = top.withColumn("_ip", IP.strip_prefix("ip"))
    wanted = F.broadcast(keyed.select("_ip").distinct())
    info = ip_info.select(F.col("ip").alias("_ip"), "country").join(wanted, "_ip", "left_semi")
    country = F.coalesce(F.when(F.col("country") != "", F.col("country")), F.lit("--"))
    return keyed.join(info, "_ip", "left").withColumn("country", country).drop("_ip")


def tail_packets(lines: DataFrame, order: str = "pkt_id", n: int = 1000) -> DataFrame:
    """The last ``n`` capture lines in capture order."""
    return lines.orderBy(F.col(order).desc()).limit(n).orderBy(order)
