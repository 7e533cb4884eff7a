"""Counters of many sensors, each with its own readings, restarts and clock.

Increases are taken per sensor, so sensors that see the same address never look like restarts of one another. To add sensors
up, readings are brought to common slots: in a slot a sensor counts with its last reading up to the slot's end, however
long ago that was. The sum of carried values is kept as a running sum of changes, so a slot has a row only where
some sensor read, and no sensor is repeated for the slots it was silent in.

Rows are ``sensor_id``, the key, ``run_ts`` and ``packets``. Of several readings of a key by one sensor in one second the largest counts; a
null sensor is a sensor of its own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dropscope.functions.times import floor_div
from dropscope.operators.deltas import CHUNK, counter_delta, ip_delta, list_delta, previous_value

IP_KEY = ["ip", "list_type"]


def on_one_clock(readings: DataFrame, clocks: DataFrame, order: str = "run_ts") -> DataFrame:
    """``readings`` in common time: ``clocks`` (sensor_id, ahead) says how many seconds a sensor's clock is ahead. Sensors it lacks are right;
    of several rows of a sensor the largest counts."""
    ahead = clocks.groupBy(F.col("sensor_id").alias("_sensor")).agg(F.max("ahead").alias("_ahead"))
    moved = readings.join(ahead, F.col("sensor_id").eqNullSafe(F.col("_sensor")), "left")
    return moved.withColumn(order, F.col(order) - F.coalesce("_ahead", F.lit(0))).select(*readings.columns)


def _distinct(readings: DataFrame, key: list[str]) -> DataFrame:
    return readings.groupBy("sensor_id", *key, "run_ts").agg(F.max("packets").alias("packets"))


def sensor_ip_delta(snapshots: DataFrame) -> DataFrame:
    """Positive increases per sensor, address and list type: ``run_ts, sensor_id, ip, count, list_type``."""
    return ip_delta(_distinct(snapshots, IP_KEY), ["sensor_id", *IP_KEY])


def sensor_list_delta(rule_counters: DataFrame) -> DataFrame:
    """Positive increases per sensor and list: ``run_ts, sensor_id, list_name, count``."""
    return list_delta(_distinct(rule_counters, ["set_name"]), ["sensor_id", "set_name"])


def running_sum(df: DataFrame, key: list[str], order: str, value: str, out: str, chunk: int) -> DataFrame:
    """``df`` plus ``out``: sum of ``value`` up to the row, per key in ``order`` (distinct per key). A window holds one key and one
    chunk of ``order``; what came before is one row per key and chunk."""
    rows = df.withColumn("_chunk", floor_div(order, chunk))
    sums = rows.groupBy(*key, "_chunk").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy(*key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))
    carry = sums.select(*[F.col(c).alias(f"_k_{c}") for c in key], F.col("_chunk").alias("_k_chunk"), F.coalesce(before, F.lit(0)).alias("_carry"))
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in key] + [F.col("_chunk") == F.col("_k_chunk")]
    here = F.sum(value).over(W.partitionBy(*key, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return rows.join(carry, on).select(*df.columns, (here + F.col("_carry")).alias(out))


def slot_totals(readings: DataFrame, key: list[str] | None = None, seconds: int = 3600) -> DataFrame:
    """Sensors added up per key and slot with a reading: ``key, slot, total, count, sensors``.

    ``slot`` is the slot's first second; ``total`` the sum of every sensor's last reading up to the slot's end; ``count`` the sum of the
    sensors' own increases in the slot, restarts included; ``sensors`` how many read in it.
    """
    key = key or IP_KEY
    own = ["sensor_id", *key]
    rows = counter_delta(_distinct(readings, key), own).withColumn("slot", floor_div("run_ts", seconds) * seconds)
    # Readings shrink to one row per sensor, key and slot before anything meets across sensors.
    closed = rows.groupBy(*own, "slot").agg(F.max_by("packets", "run_ts").alias("_last"), F.sum("delta").alias("_count"))
    stepped = previous_value(closed, own, "slot", "_last", max(CHUNK, 96 * seconds))
    change = F.col("_last") - F.coalesce("prev", F.lit(0))
    added = stepped.groupBy(*key, "slot").agg(F.sum(change).alias("_change"), F.sum("_count").alias("count"), F.count("*").alias("sensors"))
    return running_sum(added, key, "slot", "_change", "total", max(CHUNK, 96 * seconds)).select(*key, "slot", "total", "count", "sensors")


def sensor_facts(snapshots: DataFrame, seconds: int = 3600) -> DataFrame:
    """Rows for one store of all sensors: increases per address and list type, stamped with their slot: ``timestamp, ip, count, list_type``."""
    rows = sensor_ip_delta(snapshots).withColumn("timestamp", floor_div("run_ts", seconds) * seconds)
    return rows.groupBy("timestamp", "ip", "list_type").agg(F.sum("count").alias("count")).select("timestamp", "ip", "count", "list_type")
