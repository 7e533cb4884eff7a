"""Holds and as-of lookups over time, without one task per key.

A hold opens only while its key is free and keeps the key until it ends: bans, set entries with a timeout. Each hold
depends on the one before, but a stretch of time can be worked on without knowing the past: for every second at which the
key may be free on entry, a stretch says when it is free on exit. Stretches are composed in a short chain, then
every stretch opens its holds by itself. So a key with a third of all rows is spread over its stretches.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dropscope.config import DAY
from dropscope.functions.times import floor_div

FOREVER = 1 << 62


def _stretches(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the lists in the last column, row by row: seconds ``free`` in order, and the hold ``start, end`` of a key
    free at each; where each row's begin."""
    lists = batch.column(batch.num_columns - 1)
    lengths, items = lists.value_lengths().to_numpy(), lists.flatten()
    row = np.repeat(np.arange(len(lists)), lengths)
    x, start, end = (items.field(k).to_numpy() for k in range(3))
    order = np.lexsort((-end, start, x, row))
    row, x, start, end = row[order], x[order], start[order], end[order]
    if (start != x).any():
        for a, b in _spans_of(row, len(lists)):
            if b - a > 1:
                # The earliest start at or after each place; of equal seconds the first says it.
                least = np.minimum.accumulate(start[a:b][::-1])[::-1]
                at = np.where(start[a:b] == least, np.arange(b - a), b - a)
                at = np.minimum.accumulate(at[::-1])[::-1]
                start[a:b], end[a:b] = least, end[a:b][at]
    first = np.ones(len(x), bool)
    first[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    return x[first], start[first], end[first], np.searchsorted(row[first], np.arange(len(lists) + 1))


def _spans_of(row: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    edges = np.searchsorted(row, np.arange(n + 1)).tolist()
    return zip(edges[:-1], edges[1:], strict=True)


def _exits(x: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry seconds and exits of a stretch: a key free by ``bounds[k]`` (and not before) leaves free at ``exits[k]``."""
    after = np.searchsorted(x, end)
    last, jump = np.arange(len(x)), after
    while (inside := jump < len(x)).any():
        # Pointer doubling: the last hold of the chain that begins at each place.
        last = np.where(inside, last[np.minimum(jump, len(x) - 1)], last)
        jump = np.where(inside, jump[np.minimum(jump, len(x) - 1)], jump)
    out = end[last]
    edge = np.append(out[1:] != out[:-1], True)
    return x[edge], out[edge]


def _tables(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, _, end, edges = _stretches(batch)
        bounds, exits, lengths = [], [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            known = (x[a:b], end[a:b]) if b - a == 1 else _exits(x[a:b], end[a:b])
            bounds.append(known[0])
            exits.append(known[1])
            lengths.append(len(known[0]))
        ends = pa.array(np.cumsum([0, *lengths]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(v), pa.int64())) for v in (bounds, exits) if v]
        if lists:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *lists], names=[*batch.schema.names[:-1], "bounds", "exits"])


def _chained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Second from which a key is free at the entry of each stretch; rows come sorted by key and time."""
    last, free = None, None
    for batch in batches:
        keys = zip(*(c.to_pylist() for c in batch.columns[:-3]), strict=True)
        lists = batch.column(batch.num_columns - 2)
        edges = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).tolist()
        bounds, exits = lists.flatten().to_pylist(), batch.columns[-1].flatten().to_pylist()
        entry = []
        for i, key in enumerate(keys):
            if key != last:
                last, free = key, None
            entry.append(free)
            k = edges[i] if free is None else bisect_left(bounds, free, edges[i], edges[i + 1])
            if k < edges[i + 1]:
                free = exits[k]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(entry, pa.int64())], names=[*batch.schema.names[:-2], "entry"])


def _opened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, start, end, edges = _stretches(batch)
        picked, owner = [], []
        entries = batch.column(batch.num_columns - 2).to_pylist()
        for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            at = a if entries[i] is None else a + int(np.searchsorted(x[a:b], entries[i]))
            while at < b:
                picked.append(at)
                owner.append(i)
                at = b if b - at == 1 else a + int(np.searchsorted(x[a:b], end[at]))
        keys = [c.take(pa.array(owner, pa.int64())) for c in batch.columns[:-3]]
        picked = np.array(picked, np.int64)
        until = pa.array(end[picked], pa.int64(), mask=end[picked] >= FOREVER)
        yield pa.RecordBatch.from_arrays([*keys, pa.array(start[picked], pa.int64()), until], names=[*batch.schema.names[:-3], "start_s", "end_s"])


def greedy_holds(opens: DataFrame, key: list[str], slot: int = DAY) -> DataFrame:
    """Holds that really open: ``key, start_s, end_s``, from candidates ``key, free, start, end``.

    A key free at second ``free`` (but not earlier than the rows before) may hold from ``start`` (at or after ``free``) to ``end``
    (null: for ever; must lie after ``free``). Of all candidates at or after the second a key becomes free, the one with the earliest
    start opens; it is unique by then longest end. A stretch is ``slot`` seconds of one key, so at most
    so many distinct seconds are in one row; rows without ``free`` are ignored.
    """
    long = lambda c: F.col(c).cast("bigint")
    row = F.struct(long("free").alias("x"), long("start").alias("s"), F.coalesce(long("end"), F.lit(FOREVER)).alias("e"))
    blocks = opens.filter(F.col("free").isNotNull()).groupBy(*key, floor_div("free", slot).alias("slot")).agg(F.collect_set(row).alias("rows"))
    plain = [blocks.schema[k] for k in [*key, "slot"]]
    longs = T.ArrayType(T.LongType())
    tables = blocks.mapInArrow(_tables, T.StructType([*plain, T.StructField("bounds", longs), T.StructField("exits", longs)]))
    chain = tables.repartition(*key).sortWithinPartitions(*key, "slot")
    entries = chain.mapInArrow(_chained, T.StructType([*plain, T.StructField("entry", T.LongType())]))
    named = entries.toDF(*[f"_e_{c}" for c in [*key, "slot"]], "entry")
    # Null-safe in all columns: a filter for one of them would keep both uses of ``blocks`` from sharing its shuffles.
    same: Column = F.col("slot").eqNullSafe(F.col("_e_slot"))
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_e_{k}"))
    joined = blocks.join(named, same).select(*key, "slot", "entry", "rows")
    out = T.StructType([*plain[:-1], T.StructField("start_s", T.LongType()), T.StructField("end_s", T.LongType())])
    return joined.mapInArrow(_opened, out)


def last_at(points: DataFrame, marks: DataFrame, key: list[str], at: str, value: str, slot: int = 600) -> DataFrame:
    """Distinct ``key, at`` of ``points`` with the ``value`` of the last of ``marks`` at or before; null without one.

    An as-of join by carrying: a window sees one key and ``slot`` units of time, the last value of earlier
    slots comes as one row per key and slot. Of marks at one instant the largest value counts; null values are no marks.
    """
    asked = points.select(*key, at).distinct().withColumns({"_ask": F.lit(1), value: F.lit(None).cast(marks.schema[value].dataType)})
    told = marks.filter(F.col(value).isNotNull()).groupBy(*key, at).agg(F.max(value).alias(value)).withColumn("_ask", F.lit(0))
    both = told.unionByName(asked).withColumn("_slot", floor_div(at, slot))
    here = W.partitionBy(*key, "_slot").orderBy(at, "_ask").rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("_here", F.last(value, ignorenulls=True).over(here)).filter("_ask = 1")
    tails = both.groupBy(*key, "_slot").agg(F.max(F.when(F.col("_ask") == 0, F.struct(at, value))).alias("_tail"))
    earlier = W.partitionBy(*key).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    carried = tails.withColumn("_carried", F.last("_tail", ignorenulls=True).over(earlier)).select(*key, "_slot", F.col(f"_carried.{value}").alias("_carried"))
    return seen.join(carried, [*key, "_slot"], "left").select(*key, at, F.coalesce("_here", "_carried").alias(value))
