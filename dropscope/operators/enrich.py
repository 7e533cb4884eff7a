"""Address details: reputation, country, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dropscope.functions import ip as IP


def enrich(ips: DataFrame, reputation: DataFrame, min_hits: int = 5) -> DataFrame:
    """``ip, total`` → ``ip, country, risk, domain, status``.

    Local sources are never looked up; quiet ones are skipped; a source without an answer is ``XX``.
    ``ips`` has one row per address, so the join key is unique on both sides.
    """
    rows = ips.withColumn("_ip", IP.strip_prefix("ip"))
    rep = reputation.filter(F.length("country") > 0).select(
        F.col("ip").alias("_ip"), F.col("country").alias("_c"), F.col("risk").alias("_r"), F.col("domain").alias("_d")
    )
    status = (
        F.when(IP.is_private("_ip"), "lan")
        .when(F.col("total") < min_hits, "skipped")
        .when(F.col("_c").isNotNull(), "known")
        .otherwise("unknown")
    )
    pick = lambda known, lan, skipped, unknown: (
        F.when(F.col("status") == "lan", lan)
        .when(F.col("status") == "skipped", skipped)
        .when(F.col("status") == "known", known)
        .otherwise(unknown)
    )
    return rows.join(rep, "_ip", "left").withColumn("status", status).select(
        F.col("_ip").alias("ip"),
        pick(F.col("_c"), F.lit("LAN"), F.lit("--"), F.lit("XX")).alias("country"),
        F.coalesce(pick(F.col("_r").cast("int"), F.lit(0), F.lit(0), F.lit(0)), F.lit(0)).alias("risk"),
        pick(
            F.col("_d"),
            F.lit("private address"),
            F.lit("too few hits to ask"),
            F.lit("no answer"),
        ).alias("domain"),
        "status",
    )


def missing_info(ip_drops: DataFrame, ip_info: DataFrame) -> DataFrame:
    """Sources without a known country, with their hits: the input of ``enrich``."""
    per_ip = ip_drops.groupBy(IP.strip_prefix("ip").alias("ip")).agg(F.sum("count").alias("total"))
    known = ip_info.filter(F.length("country") > 0).select("ip")
    return per_ip.join(known, "ip", "left_anti")
