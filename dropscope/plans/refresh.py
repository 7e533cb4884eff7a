"""Scheduled jobs: blocklist refresh, statistics run, retention run, report run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropscope.config import SET_TAGS, Config
from dropscope.operators import abuse, deltas, flows, netsets, retention
from dropscope.operators.enrich import enrich, missing_info
from dropscope.sources import store as S
from dropscope.sources import text as X

# Fewest raw lines a download must have before it replaces a set.
MIN_LINES_V4, MIN_LINES_V6 = 50, 10
# Ban sets whose drops are counted by a trap chain.
TRAP_CHAINS = {"AutoBan": "trap"}


def clean_v4(lines: DataFrame) -> DataFrame:
    """Raw list text to the fewest networks covering it: ``set_name, net``."""
    nets = netsets.minimal_cidrs(netsets.merge_cidrs(X.ingest_blocklist(lines, 4)))
    return nets.select(F.lit("FirewallBlock").alias("set_name"), "net")


def clean_v6(lines: DataFrame) -> DataFrame:
    return X.ingest_blocklist(lines, 6).select(F.lit("FirewallBlock6").alias("set_name"), "net")


def refresh_blocklist(lines: DataFrame, store: str, family: int, as_of: int) -> int | None:
    """Publish a new main set from raw lines, unless there are too few of them."""
    floor = MIN_LINES_V4 if family == 4 else MIN_LINES_V6
    name = "FirewallBlock" if family == 4 else "FirewallBlock6"
    # limit() stops the scan as soon as the guard is met.
    if lines.limit(floor).count() < floor:
        return S.current_version(lines.sparkSession, store, f"set_{name}")
    rows = clean_v4(lines) if family == 4 else clean_v6(lines)
    return S.publish_set(rows, store, name, as_of)


def refresh_zones(lines: DataFrame, store: str, config: Config, as_of: int) -> None:
    """Publish both country sets; no banned countries empties them."""
    spark = lines.sparkSession
    if S.clear_disabled_geo(spark, store, config.banned_countries, as_of):
        return
    nets = X.ingest_zones(lines, config.banned_countries)
    name = F.when(F.col("net").contains(":"), "GeoBlock6").otherwise("GeoBlock").alias("set_name")
    rows = nets.select(name, "net").distinct()
    for s in ("GeoBlock", "GeoBlock6"):
        S.publish_set(rows, store, s, as_of)


def read_sets(spark: SparkSession, store: str) -> DataFrame:
    """All published sets as one table; sets never published are absent."""
    out = S.empty(spark, "net_set").select("set_name", "net")
    for name in [*SET_TAGS, "FirewallWhite", "FirewallWhite6"]:
        if S.current_version(spark, store, f"set_{name}") is not None:
            out = out.unionByName(S.read_versioned(spark, store, f"set_{name}").select("set_name", "net"))
    return out


def statistics_run(
    spark: SparkSession,
    store: str,
    rule_counters: DataFrame,
    snapshots: DataFrame,
    packets: DataFrame | None,
    as_of: int,
    trap_lines: DataFrame | None = None,
) -> None:
    """Append list and address deltas, then merge the capture, if any, into the details table.

    The readings of a counter's last day are carried in two versioned tables, so a reading may come up to a day late: it
    changes its own increase and that of the next reading, also across a restart, and what is stored is settled by
    signed rows. Older ones are passed over; their increase is part of a later one's. A run that is repeated, or was
    lost between any two of its steps and runs again, adds nothing twice: known readings are passed over, and rows are
    settled against what is stored. With ``trap_lines`` the ban series come from their trap chains.
    """
    lists = rule_counters if trap_lines is None else deltas.list_counters(rule_counters, trap_lines, TRAP_CHAINS)
    for name, fact, key, readings in (
        ("list_counters", "drops", ["set_name"], lists),
        ("ip_counters", "ip_drops", ["ip", "list_type"], snapshots.filter("ip is not null")),
    ):
        recent = S.read_or_empty(spark, store, name)
        fresh = deltas.unseen_readings(readings, recent, key)
        right = deltas.revised_delta(fresh, recent, key).withColumnsRenamed({"run_ts": "timestamp", "set_name": "list_name", "delta": "count"})
        S.settle(right, store, fact)
        S.publish(deltas.recent_readings(fresh, recent, key), store, name, as_of)
    if packets is not None:
        info = S.load_store(spark, store)["ip_info"]
        S.publish(flows.apply_port_history(info, packets, as_of), store, "ip_info", as_of)


def enrichment_run(spark: SparkSession, store: str, reputation: DataFrame, as_of: int) -> None:
    """Look up every source without a country and store the answers."""
    tables = S.load_store(spark, store)
    found = enrich(missing_info(tables["ip_drops"], tables["ip_info"]), reputation)
    rows = flows.enrich_all_sources(tables["ip_info"], found, as_of)
    S.publish(S.upsert(tables["ip_info"], rows, ["ip"]), store, "ip_info", as_of)


def retention_run(spark: SparkSession, store: str, as_of: int) -> None:
    """Roll newly closed days into the daily tiers, drop old facts of unprotected sources, add up months and years, prune ``ip_info``.

    The old tier, the raw rows after it and the rows too late for it are read, not older raw rows; late rows so become
    part of their days and age like all others. ``load_store`` then reads the new tier. A tier is rolled up once a day; a
    clock before the day of the last run changes nothing.
    """
    edges, today = {name: S.boundary(spark, store, name) for name in S.FACTS}, retention.closed_day(as_of)
    if any(edge is not None and edge > today for edge in edges.values()):
        return
    vip = retention.vip_ips(S.read_history(spark, store, "ip_drops"), as_of)
    if edges["drops"] != today:
        S.publish(retention.rollup(S.read_history(spark, store, "drops"), ["list_name"], as_of), store, "drops_daily", as_of)
    if edges["ip_drops"] != today:
        aged = retention.rollup(S.read_history(spark, store, "ip_drops"), ["ip", "list_type"], as_of)
        S.publish_tier(retention.retain_ip_drops(aged, vip, as_of), store, "ip_drops", as_of)
    S.publish_tiles(spark, store, as_of)
    tables = S.load_store(spark, store)
    S.publish(retention.prune_ip_info(tables["ip_info"], tables["ip_drops"]), store, "ip_info", as_of)


def report_run(spark: SparkSession, store: str, config: Config, as_of: int) -> DataFrame:
    """Build and store the report queue, remember what was reported, return the outcome counts."""
    tables = S.load_store(spark, store)
    queue = abuse.report_queue(tables["ip_drops"], tables["ip_info"], tables["abuse_reports"], config, as_of)
    S.publish(queue, store, "report_queue", as_of)
    stored = S.read_versioned(spark, store, "report_queue")
    after = S.upsert(tables["abuse_reports"], abuse.reports_after(stored, as_of), ["ip"])
    S.publish(after, store, "abuse_reports", as_of)
    return abuse.run_summary(stored)
