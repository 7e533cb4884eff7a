"""Flows from captures and the port history they feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dropscope.functions import ports as P
from dropscope.functions import ip as IP
from dropscope.operators.holds import last_at


def distinct_flows(packets: DataFrame) -> DataFrame:
    """Distinct (ip, port, proto)."""
    return packets.select("ip", "port", "proto").distinct()


def active_history(flows: DataFrame, ip_info: DataFrame) -> DataFrame:
    """Stored port text of the sources of this capture, empty where none is known."""
    active = flows.select("ip").distinct()
    info = ip_info.select("ip", "port_history")
    return active.join(info, "ip", "left").withColumn("port_history", F.coalesce("port_history", F.lit("")))


def seen_ports(packets: DataFrame) -> DataFrame:
    """Per source: sorted set of ports seen and the port of the latest packet.

    Packets shrink to the last sighting of each (ip, port, proto) first, so a source contributes at
    most 131,070 entries to its array however many packets it sent.
    """
    last = packets.groupBy("ip", "port", "proto").agg(F.max("ts_us").alias("ts_us"))
    return last.groupBy("ip").agg(
        F.array_sort(F.collect_set(F.struct("port", "proto"))).alias("seen"),
        F.max_by("port", F.struct("ts_us", "port")).alias("last_port"),
    )


def merge_port_history(ip_info: DataFrame, packets: DataFrame) -> DataFrame:
    """New history of every source of the capture: stored entries in order, then unseen ones.

    ``ip, target_port, port_history, known``; ``known`` tells whether the source has a details row.
    """
    info = ip_info.select("ip", "port_history", F.lit(True).alias("known"))
    rows = seen_ports(packets).join(info, "ip", "left")
    return rows.select(
        "ip",
        F.col("last_port").alias("target_port"),
        P.add_to_history("port_history", "seen").alias("port_history"),
        F.coalesce("known", F.lit(False)).alias("known"),
    )


def apply_port_history(ip_info: DataFrame, packets: DataFrame, as_of: int) -> DataFrame:
    """Details table with new ports for sources it already has; never adds a row."""
    new = seen_ports(packets)
    merged = P.add_to_history("port_history", "seen")
    hit = F.col("seen").isNotNull()
    changed = {
        "target_port": F.when(hit, F.col("last_port")).otherwise(F.col("target_port")),
        "port_history": F.when(hit, merged).otherwise(F.col("port_history")),
        "updated": F.when(hit, F.lit(as_of).cast("long")).otherwise(F.col("updated")),
    }
    cols = [changed[c].alias(c) if c in changed else F.col(c) for c in ip_info.columns]
    return ip_info.join(new, "ip", "left").select(*cols)


def enrich_all_sources(ip_info: DataFrame, enriched: DataFrame, as_of: int) -> DataFrame:
    """Rows to upsert into the details table after a reputation pass; known ports are kept."""
    old = ip_info.select("ip", "target_port", "port_history")
    return enriched.join(old, "ip", "left").select(
        "ip", "country", "risk", "domain", F.lit(as_of).cast("long").alias("updated"), "target_port", "port_history"
    )


def port_at_hit(ip_drops: DataFrame, packets: DataFrame) -> DataFrame:
    """Every hit with the port its source used last, up to and including the hit's second: ``ip_drops`` plus ``full_port`` (``port/proto``;
    null where nothing was seen before).

    ``packets``: ts_us, ip, port, proto. An as-of join per address and day (see ``holds.last_at``), so a source with a
    third of all hits is as many pieces as it has days; seconds are looked up once, whatever their hits. Of several
    packets of one microsecond the largest label counts.
    """
    timed = ip_drops.withColumns({"_host": IP.strip_prefix("ip", only_host=True), "_us": F.col("timestamp") * 1000000 + 999999})
    label = F.concat_ws("/", F.col("port").cast("string"), "proto")
    seen = packets.filter(F.col("port").isNotNull()).select(F.col("ip").alias("_host"), F.col("ts_us").alias("_us"), label.alias("full_port"))
    found = last_at(timed, seen, ["_host"], "_us", "full_port", slot=86400 * 1000000)
    return timed.join(found, ["_host", "_us"], "left").select(*ip_drops.columns, "full_port")


def port_credit(ip_drops: DataFrame, packets: DataFrame) -> DataFrame:
    """Hits by the port used at their time: ``full_port, ips, total``; an address counts for every port it used."""
    rows = port_at_hit(ip_drops, packets).groupBy("full_port", "ip").agg(F.sum("count").alias("total"))
    return rows.groupBy("full_port").agg(F.count("ip").alias("ips"), F.sum("total").alias("total"))
