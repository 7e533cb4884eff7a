"""Port sightings beside the details table: written per batch, merged at read, compacted on schedule.

A batch appends the last sighting of each (ip, port, proto) it holds to ``port_changes`` and touches nothing else, so what a
trigger writes is bounded by its packets. ``read_details`` folds all sightings into the details table as it
stands. Sightings keep their times, so the result is the batch form's however packets are cut into
batches and however late they come. ``compact`` merges batches into one sorted, versioned table with a row per (ip, port,
proto); the version and the last batch it holds switch together, and a batch it holds is not read again.

A replayed batch overwrites its own folder. Merging a sighting twice changes nothing. Folders of batches up to the last
compacted one may be removed by the scheduler. The log of a store belongs to one checkpoint, whose batch numbers it uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from dropscope.functions import ports as P
from dropscope.operators import flows
from dropscope.sources import store as S

CHANGES, MERGED = "port_changes", "port_sightings"
SIGHTING = "ip STRING, port INT, proto STRING, ts_us BIGINT, at BIGINT"


def latest(sightings: DataFrame) -> DataFrame:
    """One row per (ip, port, proto): last sighting, and the clock of the last run that brought one."""
    return sightings.groupBy("ip", "port", "proto").agg(F.max("ts_us").alias("ts_us"), F.max("at").alias("at"))


def stream_port_changes(packets: DataFrame, store: str, checkpoint: str, as_of: int) -> DataStreamWriter:
    """Append every micro-batch of packets (ts_us, ip, port, proto) to the sightings of a store."""

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.filter(F.col("ip").isNotNull()).withColumn("at", F.lit(as_of).cast("bigint"))
        S.align_schema(latest(rows), StructType.fromDDL(SIGHTING)).write.mode("overwrite").parquet(f"{store}/{CHANGES}/batch={batch_id}")

    return packets.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def compacted_through(spark: SparkSession, store: str) -> int:
    """Last batch that the merged table holds; -1 if none. A version of that table has this batch as its clock."""
    log = S._version_log(spark, store, MERGED)
    return -1 if log is None else log.agg(F.max_by("committed_at", "version")).first()[0]


def _pending(spark: SparkSession, store: str, after: int) -> DataFrame:
    """Sightings of batches after ``after``; folders of earlier ones are pruned."""
    try:
        rows = spark.read.schema(f"{SIGHTING}, batch INT").parquet(f"{store}/{CHANGES}")
    except AnalysisException as e:
        if not S._missing(e):
            raise
        rows = spark.createDataFrame([], f"{SIGHTING}, batch INT")
    return rows.filter(F.col("batch") > after)


def read_sightings(spark: SparkSession, store: str) -> DataFrame:
    """``ip, port, proto, ts_us, at``: the merged table and the batches since, one row per key."""
    through = compacted_through(spark, store)
    rows = _pending(spark, store, through).drop("batch")
    if through >= 0:
        rows = S.read_versioned(spark, store, MERGED).unionByName(rows)
    return latest(rows)


def fold(ip_info: DataFrame, sightings: DataFrame) -> DataFrame:
    """Details with the ports of ``sightings`` for sources they already have; never adds a row.

    ``updated`` never falls, so details published from a fold can be folded with the same sightings again.
    """
    clocks = sightings.groupBy("ip").agg(F.max("at").alias("_at"))
    new = flows.seen_ports(sightings).join(clocks, "ip")
    hit = F.col("seen").isNotNull()
    changed = {
        "target_port": F.when(hit, F.col("last_port")).otherwise(F.col("target_port")),
        "port_history": F.when(hit, P.add_to_history("port_history", "seen")).otherwise(F.col("port_history")),
        "updated": F.greatest("updated", "_at"),
    }
    return ip_info.join(new, "ip", "left").select(*[changed.get(c, F.col(c)).alias(c) for c in ip_info.columns])


def read_details(spark: SparkSession, store: str) -> DataFrame:
    """The details table as of all batches written."""
    return fold(S.read_or_empty(spark, store, "ip_info"), read_sightings(spark, store))


def compact(spark: SparkSession, store: str, through: int | None = None) -> int:
    """Merge the batches up to ``through`` into the merged table; returns the last batch it now holds.

    By default all but the newest batch, which may still be being written. Sightings of sources without a details row
    leave, as the batch form never keeps them. Rows are dealt by ranges of address, so row-group statistics prune lookups.
    """
    held = compacted_through(spark, store)
    if through is None:
        newest = _pending(spark, store, held).agg(F.max("batch")).first()[0]
        through = held if newest is None else newest - 1
    if through <= held:
        return held
    rows = _pending(spark, store, held).filter(F.col("batch") <= through).drop("batch")
    if held >= 0:
        rows = S.read_versioned(spark, store, MERGED).unionByName(rows)
    known = S.read_or_empty(spark, store, "ip_info").select("ip").distinct()
    rows = latest(rows.join(known, "ip", "left_semi"))
    key = ["ip", "port", "proto"]
    S.publish(rows.repartitionByRange(*key).sortWithinPartitions(*key), store, MERGED, as_of=through)
    return through
