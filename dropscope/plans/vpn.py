"""Jobs on VPN bans: import of stored bans, log scan, clean-up after a new main set.

The ban list (``vpn_bans``: address and the run that banned it, null for imported ones) outlives the set ``VPNBlock``, which may be emptied at
any restart. A scan first writes its verdicts, then the ban list, then the set, which follows from the two: a run lost between
two steps and run again ends in the same list and set. A step that has nothing to change publishes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropscope.functions import ip as IP
from dropscope.operators import deltas, netsets
from dropscope.sources import store as S
from dropscope.sources import text as X

MAIN_SET, VPN_SET = "FirewallBlock", "VPNBlock"


def _published(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A published set in full shape; empty if it never was."""
    if S.current_version(spark, store, f"set_{name}") is None:
        return S.empty(spark, "net_set")
    return S.align_schema(S.read_versioned(spark, store, f"set_{name}"), S.table_schema("net_set"))


def _addresses(lines: DataFrame) -> DataFrame:
    return X.extract_ipv4(lines).filter(IP.v4_to_long("ip").isNotNull())


def import_bans(lines: DataFrame, store: str, as_of: int) -> None:
    """Addresses anywhere in the lines of a ban file join the ban list; known ones keep their run."""
    bans = S.read_or_empty(lines.sparkSession, store, "vpn_bans")
    fresh = _addresses(lines).join(bans.select("ip"), "ip", "left_anti")
    rows = bans.unionByName(fresh.select("ip", F.lit(None).cast("bigint").alias("since")))
    S.publish(rows, store, "vpn_bans", as_of)


def scan_verdicts(attackers: DataFrame, bans: DataFrame, net_set: DataFrame) -> DataFrame:
    """``ip, stored, seen, status`` of every address that is banned or attacks.

    ``global``: the main set holds it; ``already``: the VPN set does; ``restored``: banned before, in neither set;
    ``banned``: a new attacker. ``stored`` and ``seen`` say whether the ban list and the log name it.
    """
    named = bans.select("ip", F.lit(True).alias("stored"), F.lit(False).alias("seen")).unionByName(
        attackers.select("ip", F.lit(False).alias("stored"), F.lit(True).alias("seen"))
    )
    named = named.groupBy("ip").agg(F.max("stored").alias("stored"), F.max("seen").alias("seen"))
    held = netsets.new_attackers(named, net_set)
    fate = F.when(F.col("status") != "new", F.col("status")).when(F.col("stored"), "restored").otherwise("banned")
    return named.join(held, "ip").select("ip", "stored", "seen", fate.alias("status"))


def scan_counts(verdicts: DataFrame) -> DataFrame:
    """One row: new bans, restored bans, stored bans the main set covers, and attackers that were banned before."""
    n = lambda cond: F.count(F.when(cond, 1))
    status = F.col("status")
    return verdicts.agg(
        n(status == "banned").alias("banned"),
        n(status == "restored").alias("restored"),
        n(F.col("stored") & (status == "global")).alias("optimized"),
        n(F.col("seen") & status.isin("already", "restored")).alias("skipped"),
    )


def vpn_scan(lines: DataFrame, store: str, as_of: int) -> DataFrame:
    """Restore stored bans, ban the attackers of a log, and return the counts of ``scan_counts``."""
    spark = lines.sparkSession
    bans, vpn = S.read_or_empty(spark, store, "vpn_bans"), _published(spark, store, VPN_SET)
    sets = _published(spark, store, MAIN_SET).unionByName(vpn)
    attackers = _addresses(X.match_attack_lines(lines))
    S.publish(scan_verdicts(attackers, bans, sets), store, "vpn_verdicts", as_of)
    verdicts = S.read_versioned(spark, store, "vpn_verdicts")
    counts = scan_counts(verdicts)
    found = counts.first()
    if found["banned"]:
        new = verdicts.filter("status = 'banned'").select("ip", F.lit(as_of).cast("bigint").alias("since"))
        S.publish(bans.unionByName(new), store, "vpn_bans", as_of)
    if found["banned"] or found["restored"]:
        added = verdicts.filter("status IN ('banned', 'restored')").select(
            F.lit(VPN_SET).alias("set_name"), F.col("ip").alias("net"), F.lit(as_of).cast("bigint").alias("added_at"), F.lit(None).cast("bigint").alias("expires_at")
        )
        S.publish_set(vpn.unionByName(added), store, VPN_SET, as_of)
    return counts


def vpn_cleanup(spark: SparkSession, store: str, as_of: int) -> DataFrame:
    """Take bans that the main set covers out of the VPN set; they stay in the ban list, so a scan brings them back once
    the main set drops them. Returns ``kept, removed``."""
    vpn = _published(spark, store, VPN_SET)
    S.publish(netsets.redundant_bans(vpn, _published(spark, store, MAIN_SET)), store, "vpn_cleanup", as_of)
    fates = S.read_versioned(spark, store, "vpn_cleanup")
    n = lambda action: F.count(F.when(F.col("action") == action, 1)).alias(action)
    counts = fates.agg(n("kept"), n("removed"))
    if counts.first()["removed"]:
        left = vpn.join(fates.filter("action = 'removed'").select("net"), "net", "left_anti")
        S.publish_set(left.select(*vpn.columns), store, VPN_SET, as_of)
    return counts


def ban_trend(bans: DataFrame) -> DataFrame:
    """New bans per run and their running total, from the ban list; imported bans have no run."""
    return deltas.vpn_trend(bans.filter("since IS NOT NULL").select(F.col("since").alias("run_ts"), F.lit(1).alias("n")))
