"""Parquet tables of one deployment, on a folder every executor can reach.

Facts are appended and partitioned by time so trailing windows prune files: ``ip_drops`` by
``event_date``; ``drops``, with a few hundred rows a day, by ``event_month``. Everything replaced as a whole (``ip_info``, ``abuse_reports``, network sets) is versioned: a job
writes a new version folder, then adds one row to the version log. Readers follow the log, so they see
the old or the new table, never a mixture; a job lost half-way leaves an unreferenced folder.

Closed days of the facts are read from a daily tier (``drops_daily``, ``ip_drops_daily``: versioned tables), raw rows
only from the tier's boundary on. The boundary follows from the clock of the tier's version, so both switch
at once. Rows that arrive for days before it are stored in partitions of their own: ``late`` is the boundary they came
too late for, 0 for all other rows. They are read beside the tier until a run with a later boundary has added them to the
tier's days; from that version on they are not, so both switch together and a lost run counts nothing twice.
Raw partitions before the boundary, and those of earlier boundaries, are no longer read and may be removed by the
scheduler.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from dropscope.config import SET_FAMILIES
from dropscope.operators.membership import apply_events
from dropscope.operators.reports import window_totals
from dropscope.operators.retention import closed_day
from dropscope.operators.tiles import tile_sums, tiled_totals
from dropscope.functions import ip as IP

SCHEMAS = {
    "drops": "timestamp BIGINT, list_name STRING, count BIGINT",
    "ip_drops": "timestamp BIGINT, ip STRING, count BIGINT, list_type STRING",
    "ip_info": "ip STRING, country STRING, risk INT, domain STRING, updated BIGINT, target_port INT, port_history STRING",
    "abuse_reports": "ip STRING, last_sent BIGINT",
    "vpn_bans": "ip STRING, since BIGINT",
    "list_counters": "set_name STRING, run_ts BIGINT, packets BIGINT",
    "ip_counters": "ip STRING, list_type STRING, run_ts BIGINT, packets BIGINT",
    "net_set": "set_name STRING, net STRING, added_at BIGINT, expires_at BIGINT",
}
# Partition column of each fact table.
FACTS = {"drops": "event_month", "ip_drops": "event_date"}
VERSION_SCHEMA = "version BIGINT, rows BIGINT, committed_at BIGINT"


def scratch_dir(spark: SparkSession) -> str:
    """New folder for intermediate tables, under the folder the cluster names. A local folder is taken only
    in local mode: elsewhere each executor would write to its own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="dropscope-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/dropscope/{uuid.uuid4().hex}"


def table_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], table_schema(name))


def align_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with every column of ``schema``; missing ones are null, extra ones go."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


# ---- appended facts -------------------------------------------------------------------------------


def append_facts(df: DataFrame, store: str, name: str, signed: bool = False) -> None:
    """One write job is one commit. Rows are spread by date and hash, so a busy day uses many tasks. Only positive counts are
    stored; ``signed`` ones correct rows of the same key and second."""
    rows = align_schema(df, table_schema(name)).filter(F.col("count") != 0 if signed else F.col("count") > 0)
    part, day = FACTS[name], F.to_date(F.timestamp_seconds("timestamp"))
    rows = rows.withColumn(part, day if part == "event_date" else F.to_date(F.trunc(day, "month")))
    edge = boundary(df.sparkSession, store, name)
    zero = F.lit(0).cast("bigint")
    rows = rows.withColumn("late", zero if edge is None else F.when(F.col("timestamp") < edge, F.lit(edge).cast("bigint")).otherwise(zero))
    # REBALANCE lets adaptive execution both merge small and split large time partitions.
    rows.hint("rebalance", part).write.mode("append").partitionBy("late", part).parquet(f"{store}/{name}")


def append_drops(df: DataFrame, store: str) -> None:
    append_facts(df, store, "drops")


def append_ip_drops(df: DataFrame, store: str) -> None:
    append_facts(df.filter(F.col("ip").isNotNull()), store, "ip_drops")


def append_once(df: DataFrame, store: str, name: str) -> None:
    """Append the rows whose key (all columns but ``count``) the table lacks, so a job that was lost after its append
    can run again. Only the partitions of the rows' own time span are read."""
    spark, schema = df.sparkSession, table_schema(name)
    path = scratch_dir(spark)
    align_schema(df, schema).write.parquet(path)
    rows = spark.read.schema(schema).parquet(path)
    low, high = rows.agg(F.min("timestamp"), F.max("timestamp")).first()
    if low is None:
        return
    day = lambda t: F.to_date(F.timestamp_seconds(F.lit(t)))
    first = F.to_date(F.trunc(day(low), "month")) if FACTS[name] == "event_month" else day(low)
    try:
        held = read_facts(spark, store, name).filter(F.col(FACTS[name]).between(first, day(high)))
    except AnalysisException as e:
        if not _missing(e):
            raise
    else:
        key = [c for c in rows.columns if c != "count"]
        rows = rows.join(held.select(*key), key, "left_anti")
    append_facts(rows, store, name)


def settle(df: DataFrame, store: str, name: str) -> None:
    """Append, per key and second (all columns but ``count``) of ``df``, what the stored rows lack for their sum to be ``count``: the whole
    count, a correction of either sign, or nothing. Running it again changes nothing. Only the partitions of the rows' own
    time span are read; rows before the daily tier's boundary must still be stored."""
    spark, schema = df.sparkSession, table_schema(name)
    path = scratch_dir(spark)
    align_schema(df, schema).write.parquet(path)
    rows = spark.read.schema(schema).parquet(path)
    low, high = rows.agg(F.min("timestamp"), F.max("timestamp")).first()
    if low is None:
        return
    day = lambda t: F.to_date(F.timestamp_seconds(F.lit(t)))
    first = F.to_date(F.trunc(day(low), "month")) if FACTS[name] == "event_month" else day(low)
    key = [c for c in rows.columns if c != "count"]
    try:
        held = read_facts(spark, store, name).filter(F.col(FACTS[name]).between(first, day(high)))
    except AnalysisException as e:
        if not _missing(e):
            raise
    else:
        sums = held.groupBy(*key).agg(F.sum("count").alias("_held"))
        lacking = F.col("count") - F.coalesce("_held", F.lit(0))
        rows = rows.join(sums, key, "left").withColumn("count", lacking).select(*schema.names)
    append_facts(rows, store, name, signed=True)


def _raw(spark: SparkSession, store: str, name: str) -> DataFrame:
    parts = [T.StructField("late", T.LongType()), T.StructField(FACTS[name], T.DateType())]
    return spark.read.schema(T.StructType(table_schema(name).fields + parts)).parquet(f"{store}/{name}")


def read_facts(spark: SparkSession, store: str, name: str) -> DataFrame:
    """All raw rows ever stored."""
    return _raw(spark, store, name).drop("late")


def _clock_edge(spark: SparkSession, store: str, table: str) -> int | None:
    """Boundary by the clock of the current version of a table; None if it has none."""
    log = _version_log(spark, store, table)
    return None if log is None else closed_day(log.agg(F.max_by("committed_at", "version")).first()[0])


def boundary(spark: SparkSession, store: str, name: str) -> int | None:
    """First second that the daily tier of a fact table does not cover; None without a tier."""
    return _clock_edge(spark, store, f"{name}_daily")


def _history_parts(spark: SparkSession, store: str, name: str, edge: int | None) -> tuple[DataFrame | None, DataFrame]:
    """The daily tier, if there is one, and the rows read beside it."""
    part, columns = FACTS[name], table_schema(name).names
    try:
        raw = _raw(spark, store, name)
    except AnalysisException as e:
        if not _missing(e):
            raise
        raw = spark.createDataFrame([], table_schema(name)).withColumns({"late": F.lit(0).cast("bigint"), part: F.lit(None).cast("date")})
    if edge is None:
        return None, raw.drop("late")
    day = F.to_date(F.timestamp_seconds(F.lit(edge)))
    first = day if part == "event_date" else F.to_date(F.trunc(day, "month"))
    fresh = raw.filter((F.col("late") == 0) & (F.col(part) >= first) & (F.col("timestamp") >= edge))
    # Rows late for an earlier boundary are in the tier; those late for it but of days after it were in time there.
    fresh = fresh.unionByName(raw.filter(F.col("late") >= edge))
    return read_versioned(spark, store, f"{name}_daily").select(*columns), fresh.drop("late")


def read_history(spark: SparkSession, store: str, name: str) -> DataFrame:
    """The daily tier up to its boundary, raw rows from there on, and those that came too late for the tier and are not
    part of it yet. Partitions of raw rows before the boundary, or late for an earlier one, are not scanned."""
    part = FACTS[name]
    tier, fresh = _history_parts(spark, store, name, boundary(spark, store, name))
    if tier is None:
        return fresh
    tier_day = F.to_date(F.timestamp_seconds("timestamp"))
    tier = tier.withColumn(part, tier_day if part == "event_date" else F.to_date(F.trunc(tier_day, "month")))
    return tier.unionByName(fresh)


def publish_tier(rows: DataFrame, store: str, name: str, as_of: int) -> None:
    """Daily tier of a fact table, in order of time, so a filter on ``timestamp`` skips row groups."""
    ordered = rows.repartitionByRange(*[c for c in ("timestamp", "ip") if c in rows.columns]).sortWithinPartitions("timestamp")
    publish(ordered, store, f"{name}_daily", as_of)


def publish_tiles(spark: SparkSession, store: str, as_of: int) -> None:
    """Month and year sums of the current tier of ``ip_drops``, unless they are there. They carry the tier's clock, so readers
    see whether they belong to the tier they read."""
    edge = boundary(spark, store, "ip_drops")
    if edge is None or _clock_edge(spark, store, "ip_drops_tiles") == edge:
        return
    sums = tile_sums(read_versioned(spark, store, "ip_drops_daily"), edge)
    publish(sums.repartitionByRange("grain", "start", "ip").sortWithinPartitions("grain", "start"), store, "ip_drops_tiles", as_of)


def stored_totals(spark: SparkSession, store: str, as_of: int) -> DataFrame:
    """``reports.window_totals`` over the store: from tiles where they belong to the tier, else (a run was lost between
    the two) from daily rows."""
    edge = boundary(spark, store, "ip_drops")
    if edge is None or _clock_edge(spark, store, "ip_drops_tiles") != edge:
        return window_totals(read_history(spark, store, "ip_drops"), as_of)
    tier, fresh = _history_parts(spark, store, "ip_drops", edge)
    return tiled_totals(fresh, tier, read_versioned(spark, store, "ip_drops_tiles"), as_of, edge)


# ---- versioned tables -----------------------------------------------------------------------------


def _missing(e: AnalysisException) -> bool:
    return e.getCondition() == "PATH_NOT_FOUND"


def _version_log(spark: SparkSession, store: str, name: str) -> DataFrame | None:
    """The version log; None only where none was ever written."""
    try:
        return spark.read.schema(VERSION_SCHEMA + ", path STRING").json(f"{store}/{name}/versions")
    except AnalysisException as e:
        if _missing(e):
            return None
        raise


def current_version(spark: SparkSession, store: str, name: str) -> int | None:
    log = _version_log(spark, store, name)
    return None if log is None else log.agg(F.max("version")).first()[0]


def publish(df: DataFrame, store: str, name: str, as_of: int = 0, min_rows: int = 0) -> int | None:
    """Write ``df`` as the next version and switch to it, unless it has fewer than ``min_rows`` rows.

    Returns the version now current. The rows counted are the rows written, read back from the file
    footers, so the input is computed once.
    """
    spark = df.sparkSession
    old = current_version(spark, store, name)
    new = (old or 0) + 1
    path = f"{store}/{name}/data/v={new}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path).count()
    if rows < min_rows:
        return old
    entry = f"SELECT {new}L AS version, {rows}L AS rows, {as_of}L AS committed_at, '{path}' AS path"
    spark.sql(entry).coalesce(1).write.mode("append").json(f"{store}/{name}/versions")
    return new


def read_versioned(spark: SparkSession, store: str, name: str, version: int | None = None) -> DataFrame:
    """Current (or a given) version of a table."""
    log = _version_log(spark, store, name)
    if log is None:
        raise FileNotFoundError(f"{name} has no version in {store}")
    if version is not None:
        log = log.filter(F.col("version") == version)
    row = log.agg(F.max_by("path", "version").alias("path")).first()
    return spark.read.parquet(row["path"])


def read_or_empty(spark: SparkSession, store: str, name: str) -> DataFrame:
    """Current version of a table with a known schema; empty if none was ever published."""
    known = _version_log(spark, store, name) is not None
    return read_versioned(spark, store, name) if known else empty(spark, name)


def load_store(spark: SparkSession, store: str) -> dict[str, DataFrame]:
    """The four tables; one not written yet is empty. A version log that names a lost folder is an error."""
    facts = {name: read_history(spark, store, name) for name in FACTS}
    return facts | {name: read_or_empty(spark, store, name) for name in ("ip_info", "abuse_reports")}


# ---- changes to versioned tables ------------------------------------------------------------------


def upsert(target: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``target`` not named in ``changes``, plus ``changes`` in the target's shape.

    Of changes with the same key the one whose other columns, in the target's order, are largest counts (nulls smallest).
    """
    rows = align_schema(changes, target.schema)
    rest = [c for c in target.columns if c not in key]
    rows = rows.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_row")).select(*key, "_row.*").select(*target.columns)
    return target.join(changes.select(*key), key, "left_anti").unionByName(rows)


def apply_ban_events(
    net_set: DataFrame, events: DataFrame, as_of: int | None = None, timeouts: dict[str, int] | None = None
) -> DataFrame:
    """Sets after a log of ``event_time, set_name, net, action`` (add/remove); the latest event per entry wins.

    With ``as_of``, entries have times: those valid at that second are returned with ``added_at`` and ``expires_at``,
    and adds last as long as ``timeouts`` says for their set (see ``membership.apply_events``).
    """
    if as_of is not None:
        return apply_events(net_set, events, as_of, timeouts)
    last = events.groupBy("set_name", "net").agg(F.max_by("action", F.struct("event_time", "action")).alias("action"))
    kept = net_set.select("set_name", "net").join(last.select("set_name", "net"), ["set_name", "net"], "left_anti")
    return kept.unionByName(last.filter(F.col("action") == "add").select("set_name", "net"))


def ban_requests(requests: DataFrame) -> DataFrame:
    """``event_time, ip, action`` (ban/unban) as set events: a ban goes to the manual set of the family,
    an unban leaves both the dynamic and the manual set."""
    sfx = F.when(IP.is_v6("ip"), "6").otherwise("")
    manual, auto = F.concat(F.lit("Blacklist"), sfx), F.concat(F.lit("AutoBan"), sfx)
    sets = F.when(F.col("action") == "ban", F.array(manual)).otherwise(F.array(auto, manual))
    return requests.filter(IP.validate_ip("ip")).select(
        "event_time",
        F.explode(sets).alias("set_name"),
        F.col("ip").alias("net"),
        F.when(F.col("action") == "ban", "add").otherwise("remove").alias("action"),
    )


def whitelist_requests(requests: DataFrame) -> DataFrame:
    """``event_time, net, action`` (add/remove) as events on the white set of the family."""
    name = F.when(IP.is_v6("net"), "FirewallWhite6").otherwise("FirewallWhite")
    return requests.select("event_time", name.alias("set_name"), "net", "action")


def flush(net_set: DataFrame, family: str | None = None) -> DataFrame:
    """All entries of one set family gone; None empties every set."""
    if family is None:
        return net_set.filter(F.lit(False))
    return net_set.filter(~F.col("set_name").isin(*SET_FAMILIES[family]))


def publish_set(net_set: DataFrame, store: str, set_name: str, as_of: int = 0, min_rows: int = 0) -> int | None:
    """New version of one set; a version under the size guard is not switched to."""
    rows = net_set.filter(F.col("set_name") == set_name)
    return publish(rows, store, f"set_{set_name}", as_of, min_rows)


def clear_disabled_geo(spark: SparkSession, store: str, countries: tuple[str, ...], as_of: int = 0) -> bool:
    """No banned countries: both country sets become empty versions."""
    if countries:
        return False
    for name in ("GeoBlock", "GeoBlock6"):
        publish(empty(spark, "net_set"), store, f"set_{name}", as_of)
    return True


def write_port_lists(lists: DataFrame, path: str) -> None:
    """One folder of text files per window, port and protocol; a huge list spreads over many files."""
    lists.select("window", "port", "proto", F.col("ip").alias("value")).hint(
        "rebalance", "window", "port", "proto"
    ).write.partitionBy("window", "port", "proto").text(path)
