"""The dashboard document: one JSON row holding list sizes, averages and 33 tables.

The facts are scanned once each: ``condense`` and ``window_totals`` shrink them to summaries whose
shuffles all tables reuse. Only cut tables (at most a few dozen rows each) are packed into the row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dropscope.config import WINDOWS, Config
from dropscope.functions import ip as IP
from dropscope.functions.ports import preview
from dropscope.operators import reports as R
from dropscope.operators.deltas import set_trend

GRAINS = ("hourly", "daily", "monthly", "yearly")


def _tables(df: DataFrame, name, order: list) -> DataFrame:
    """``table, pos, row`` with the row as JSON text."""
    return df.select(name.alias("table"), F.array(*[o.cast("double") for o in order]).alias("pos"), F.to_json(F.struct("*")).alias("row"))


def series_tables(drops: DataFrame, as_of: int) -> DataFrame:
    base = R.condense(drops, as_of)
    parts = [
        _tables(R.drop_series(base, g, as_of), F.lit(g), [-F.col("newest")]) for g in GRAINS
    ]
    parts.append(_tables(R.top_days(base), F.lit("top_days"), [-F.col("total"), -F.col("newest")]))
    return reduce(DataFrame.unionByName, parts)


def ip_tables(ip_drops: DataFrame, ip_info: DataFrame, as_of: int) -> DataFrame:
    """The 20 source tables with details; 200 rows at most meet the details table."""
    top = R.top_ips(ip_drops, as_of).withColumn("info_ip", IP.strip_prefix("ip"))
    rows = R.attach_info(top, ip_info, 200)
    rows = rows.withColumn("ports", preview(F.filter(F.split(F.coalesce("port_history", F.lit("")), ","), lambda x: x != "")))
    rows = rows.drop("port_history")
    return _tables(rows, F.concat_ws("_", "family", "window"), [F.col("rank")])


def port_tables(ip_drops: DataFrame, ip_info: DataFrame, config: Config, as_of: int) -> DataFrame:
    ports = R.port_stats(ip_drops, ip_info, as_of)
    brute = R.bruteforce_stats(ip_drops, ip_info, config.tcp_services, config.udp_services, as_of)
    return _tables(ports, F.concat(F.lit("ports_"), "window"), [F.col("rank")]).unionByName(
        _tables(brute, F.concat(F.lit("brute_"), "window"), [F.col("rank")])
    )


def table_names() -> list[str]:
    families = ["trap", "hosts", "nets", "ipv6", "geo", "ports", "brute"]
    return [*GRAINS, "top_days", *[f"{f}_{w}" for w in WINDOWS for f in families]]


def _member(name: str, df: DataFrame, text) -> DataFrame:
    """One row ``name, text``: a member of the document with its JSON value."""
    return df.select(F.lit(name).alias("name"), text.alias("text"))


def dashboard(
    store: dict[str, DataFrame], size_history: DataFrame, config: Config, as_of: int
) -> DataFrame:
    """One row: ``document`` (JSON text)."""
    drops, facts, info = store["drops"], store["ip_drops"], store["ip_info"]
    rows = (
        series_tables(drops, as_of)
        .unionByName(ip_tables(facts, info, as_of))
        .unionByName(port_tables(facts, info, config, as_of))
    )
    packed = rows.groupBy("table").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "row"))), lambda x: x["row"]), ",").alias("rows")
    )
    named = []
    for t in table_names():
        found = F.coalesce(F.max(F.when(F.col("table") == t, F.col("rows"))), F.lit(""))
        named.append(F.concat(F.lit(f'"{t}":['), found, F.lit("]")))
    tables = packed.agg(F.concat(F.lit("{"), F.concat_ws(",", *named), F.lit("}")).alias("t"))
    averages = reduce(DataFrame.unionByName, [R.avg_per_bucket(R.condense(drops, as_of), g, as_of) for g in GRAINS])
    averages = averages.agg(F.map_from_entries(F.collect_list(F.struct("grain", "average"))).alias("m"))
    last = set_trend(size_history).groupBy("set_name").agg(
        F.max_by(F.struct("n", "trend", F.col("run_ts").alias("updated")), "run_ts").alias("s")
    )
    lists = last.agg(F.map_from_entries(F.collect_list(F.struct("set_name", "s"))).alias("m"))
    members = [
        _member("lifetime", R.lifetime_drops(drops), F.col("total").cast("string")),
        _member("lists", lists, F.to_json("m")),
        _member("averages", averages, F.to_json("m")),
        _member("tables", tables, F.col("t")),
    ]
    head = f'{{"updated":{as_of},"ipv6_status":{str(config.ipv6).lower()}'
    one = [
        F.concat(F.lit(f',"{n}":'), F.coalesce(F.max(F.when(F.col("name") == n, F.col("text"))), F.lit("{}")))
        for n in ("lifetime", "lists", "averages", "tables")
    ]
    return reduce(DataFrame.unionByName, members).agg(F.concat(F.lit(head), *one, F.lit("}")).alias("document"))
