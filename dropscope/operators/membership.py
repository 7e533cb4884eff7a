"""Which networks were in which sets when.

Set events become validity intervals ``added_at, expires_at`` (seconds; null end: still valid) in the shape of the stored
sets. An entry lives from its add to its timeout, its removal, or the next flush or rebuild of its set, whichever comes
first; adding a live entry changes nothing, so a timeout is never extended. A rebuild empties the set and
gives it a new timeout. At one second, flushes and rebuilds come first, then adds, then removals.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dropscope.functions.times import floor_div
from dropscope.operators.holds import greedy_holds, last_at
from dropscope.operators.netsets import matched_nets

EVENT_SCHEMA = "event_time BIGINT, set_name STRING, net STRING, action STRING, timeout BIGINT"


def _first_at(points: DataFrame, marks: DataFrame, key: list[str], at: str) -> DataFrame:
    """``key, at, next``: time of the first of ``marks`` at or after; a lookup backwards in time."""
    back = lambda df: df.select(*key, (-F.col(at)).alias("_back"))
    own = back(marks).withColumn("_found", F.col("_back"))
    found = last_at(back(points), own, key, "_back", "_found", slot=86400)
    return found.select(*key, (-F.col("_back")).alias(at), (-F.col("_found")).alias("next"))


def set_intervals(events: DataFrame, timeouts: dict[str, int] | None = None) -> DataFrame:
    """``set_name, net, added_at, expires_at`` from events ``event_time, set_name, net, action, timeout``.

    ``action`` is add (``timeout`` in seconds, 0: none, null: that of the set), remove, flush or rebuild (with the
    set's new ``timeout``). ``timeouts`` holds the sets' first timeouts; sets not named have none. What holds for an
    add (the set's timeout, the next cut) is looked up by second, so repeated adds of one second cost one lookup.
    """
    action, entry = F.col("action"), ["set_name", "net"]
    dated = events.withColumn("t", F.col("event_time").cast("bigint")).filter("t IS NOT NULL AND set_name IS NOT NULL")
    whole = dated.filter(action.isin("flush", "rebuild"))
    own = dated.filter(action.isin("add", "remove") & F.col("net").isNotNull())
    adds = own.filter("action = 'add'").select(*entry, "t", "timeout")
    new = whole.filter("action = 'rebuild'").select("set_name", "t", F.coalesce("timeout", F.lit(0)).cast("bigint").alias("new"))
    told = last_at(adds, new, ["set_name"], "t", "new", slot=86400)
    wiped = _first_at(adds.select("set_name", (F.col("t") + 1).alias("t")), whole, ["set_name"], "t")
    wiped = wiped.select("set_name", (F.col("t") - 1).alias("t"), F.col("next").alias("wiped"))
    given: Column = F.lit(0).cast("bigint")
    for name, seconds in (timeouts or {}).items():
        given = F.when(F.col("set_name") == name, F.lit(seconds).cast("bigint")).otherwise(given)
    cuts = _first_at(adds, own.filter("action = 'remove'"), entry, "t")
    adds = adds.join(told, ["set_name", "t"], "left").join(wiped, ["set_name", "t"], "left")
    adds = adds.select(*entry, "t", F.coalesce("timeout", "new", given).alias("life"), "wiped")
    opens = adds.join(cuts, [*entry, "t"], "left").withColumn("cap", F.least("next", "wiped"))
    opens = opens.filter(F.col("cap").isNull() | (F.col("cap") > F.col("t")))
    end = F.when(F.col("life") > 0, F.col("t") + F.col("life"))
    # Adds between two cuts share their cap, so each stretch of life is a key of its own.
    held = greedy_holds(opens.select(*entry, "cap", F.col("t").alias("free"), F.col("t").alias("start"), end.alias("end")), [*entry, "cap"])
    return held.select(*entry, F.col("start_s").alias("added_at"), F.least("end_s", "cap").alias("expires_at"))


def live_at(net_set: DataFrame, as_of: int) -> DataFrame:
    """Entries valid at ``as_of``; a null ``added_at`` is before all times."""
    begun = F.coalesce("added_at", F.lit(as_of)) <= as_of
    return net_set.filter(begun & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)))


def as_events(net_set: DataFrame, at: int = 0) -> DataFrame:
    """Stored entries as adds that keep their end; ``at`` where no time is stored."""
    begun = F.coalesce("added_at", F.lit(at)).cast("bigint")
    left = F.coalesce(F.col("expires_at") - begun, F.lit(0))
    return net_set.select(begun.alias("event_time"), "set_name", "net", F.lit("add").alias("action"), left.cast("bigint").alias("timeout"))


def apply_events(net_set: DataFrame, events: DataFrame, as_of: int, timeouts: dict[str, int] | None = None) -> DataFrame:
    """Stored sets after ``events`` (those up to ``as_of``): entries then valid, with their times."""
    if "timeout" not in events.columns:
        events = events.withColumn("timeout", F.lit(None).cast("bigint"))
    both = as_events(net_set).unionByName(events.select("event_time", "set_name", "net", "action", "timeout"))
    return live_at(set_intervals(both.filter(F.col("event_time") <= as_of), timeouts), as_of)


def _lives(net_set: DataFrame, slot: int) -> DataFrame:
    """``set_name, _net, _slot, _at, _by, _sum``: per entry and ``slot`` seconds, in which seconds of the slot the number of its
    lives changes, by how much, and in all. A null ``added_at`` is before all times."""
    begun, ended = F.coalesce("added_at", F.lit(-(1 << 40))).cast("bigint"), F.col("expires_at").cast("bigint")
    valid = net_set.filter(F.col("set_name").isNotNull() & F.col("net").isNotNull() & (ended.isNull() | (ended > begun)))
    steps = F.array(F.struct(begun.alias("t"), F.lit(1).alias("d")), F.struct(ended.alias("t"), F.lit(-1).alias("d")))
    rows = valid.select("set_name", F.col("net").alias("_net"), F.inline(steps)).filter("t IS NOT NULL")
    rows = rows.select("set_name", "_net", floor_div("t", slot).alias("_slot"), F.pmod("t", F.lit(slot)).cast("int").alias("t"), "d")
    # One shuffle for both sums; a row ends with at most one step per second of the slot.
    key = ["set_name", "_net", "_slot"]
    rows = rows.repartition(*key).groupBy(*key, "t").agg(F.sum("d").alias("d")).filter("d <> 0")
    step = F.struct("t", F.col("d").cast("int").alias("d"))
    lives = rows.groupBy(*key).agg(F.array_sort(F.collect_list(step)).alias("_steps"), F.sum("d").alias("_sum"))
    return lives.select(*key, F.col("_steps.t").alias("_at"), F.col("_steps.d").alias("_by"), "_sum")


def _alive(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the seconds each row asks for, those at which its entry has a life."""
    for batch in batches:
        slot, asked, before, steps, by = batch.columns[2:]
        n = batch.num_rows
        row = np.repeat(np.arange(n), asked.value_lengths().to_numpy())
        at = asked.flatten().to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(n), steps.value_lengths().to_numpy())
        total = np.concatenate([[0], np.cumsum(by.flatten().to_numpy().astype(np.int64))])
        # Steps are in order of row and second, so one search finds the last step of every asked second.
        known = owner * (1 << 32) + steps.flatten().to_numpy()
        last, first = np.searchsorted(known, row * (1 << 32) + at, side="right"), np.searchsorted(owner, row)
        live = before.to_numpy()[row] + total[last] - total[first] > 0
        row, at = row[live], slot.to_numpy()[row[live]] + at[live]
        pick = pa.array(row, pa.int64())
        names = [*batch.schema.names[:2], "_second"]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(at, pa.int64())], names=names)


def sets_at(points: DataFrame, net_set: DataFrame, col: str, second: str, slot: int = 600) -> DataFrame:
    """Distinct ``col, second`` of ``points`` with every set that held the address then: ``col, second, set_name``.

    Addresses meet networks by prefix once each, whatever the time. Then an address asks each of its networks, ``slot``
    seconds in one row, at which of its seconds the network was alive: the network's steps in those seconds and the lives
    carried into them. So lives are never repeated for every address in a shuffle, and a row holds at most ``slot``
    seconds and as many steps. Entries may overlap: lives are counted.
    """
    key = ["set_name", "_net", "_slot"]
    at = F.col(second).cast("bigint")
    times = points.filter(at.isNotNull()).groupBy(col, floor_div(at, slot).alias("_slot"))
    asked = times.agg(F.collect_set(F.pmod(at, F.lit(slot)).cast("int")).alias("_asked")).join(matched_nets(points, net_set, col), col)
    lives = _lives(net_set, slot)
    salts = asked.groupBy(*key).agg(F.collect_set("salt").alias("_salts"))
    earlier = W.partitionBy("set_name", "_net").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    held = lives.join(salts, key, "full_outer").withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    changes = [F.coalesce(c, F.array().cast("array<int>")).alias(c) for c in ("_at", "_by")]
    held = held.withColumn("salt", F.explode("_salts")).select(*key, "salt", "_before", *changes)
    # What neither lived before nor begins to live in its slot is not asked.
    held = held.filter((F.col("_before") > 0) | (F.size("_at") > 0))
    rows = asked.join(held, [*key, "salt"]).select(col, "set_name", (F.col("_slot") * slot).alias("_slot"), "_asked", "_before", "_at", "_by")
    out = T.StructType([rows.schema[col], rows.schema["set_name"], T.StructField("_second", T.LongType())])
    found = rows.mapInArrow(_alive, out).select(col, F.col("_second").cast(points.schema[second].dataType).alias(second), "set_name")
    # Several networks of a set may hold an address. Dealt by point, the rows also serve what groups or joins by point.
    return found.repartition(col, second).distinct()
