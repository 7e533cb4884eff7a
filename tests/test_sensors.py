"""Counters of many sensors against plain Python."""

import collections
import random

import pytest

from dropscope.operators import sensors

SNAPSHOT = "sensor_id STRING, run_ts BIGINT, ip STRING, list_type STRING, packets BIGINT"


@pytest.fixture(scope="module")
def rows():
    """Sensors that read at their own times, restart now and then, and fall silent for days."""
    rng = random.Random(11)
    out = []
    for sensor in ("a", "b", None):
        for ip in ("198.51.0.1", "198.51.0.2", "2001:db8::1"):
            value = 0
            for _ in range(60):
                value = rng.randrange(5) if rng.random() < 0.1 else value + rng.randrange(4)
                out.append((sensor, rng.choice((0, 3, 40)) * 86400 + rng.randrange(86400) - 20_000, ip, rng.choice(("main", "trap")), value))
    return out + out[:5]


def read(rows):
    """Readings per (sensor, ip, list_type) in order, the largest of a second."""
    last = collections.defaultdict(dict)
    for s, t, ip, kind, n in rows:
        last[s, ip, kind][t] = max(n, last[s, ip, kind].get(t, 0))
    return {k: sorted(v.items()) for k, v in last.items()}


def increases(readings):
    prev, out = 0, []
    for t, n in readings:
        out.append((t, n if n < prev else n - prev))
        prev = n
    return out


def test_increases_are_each_sensors_own(spark, rows):
    got = sensors.sensor_ip_delta(spark.createDataFrame(rows, SNAPSHOT)).collect()
    want = [(t, s, ip, d, kind) for (s, ip, kind), r in read(rows).items() for t, d in increases(r) if d > 0]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("seconds", [60, 3600, 86400])
def test_slots_carry_last_values(spark, rows, seconds):
    got = sensors.slot_totals(spark.createDataFrame(rows, SNAPSHOT), seconds=seconds).collect()
    by, want = read(rows), []
    keys = {k[1:] for k in by}
    for ip, kind in keys:
        own = {s: by[s, ip, kind] for s in ("a", "b", None) if (s, ip, kind) in by}
        for slot in {t // seconds * seconds for r in own.values() for t, _ in r}:
            end = slot + seconds
            total = sum(next((n for t, n in reversed(r) if t < end), 0) for r in own.values())
            count = sum(d for r in own.values() for t, d in increases(r) if slot <= t < end)
            want.append((ip, kind, slot, total, count, sum(any(slot <= t < end for t, _ in r) for r in own.values())))
    assert sorted(map(tuple, got)) == sorted(want)


def test_clocks_and_facts(spark, rows):
    frame = spark.createDataFrame(rows, SNAPSHOT)
    clocks = spark.createDataFrame([("a", 1000), ("a", 900), (None, -50), ("other", 7)], "sensor_id STRING, ahead BIGINT")
    moved = sensors.on_one_clock(frame, clocks)
    ahead = {"a": 1000, "b": 0, None: -50}
    right = [(s, t - ahead[s], ip, kind, n) for s, t, ip, kind, n in rows]
    assert moved.columns == frame.columns and sorted(map(tuple, moved.collect()), key=str) == sorted(right, key=str)
    want = collections.Counter()
    for (_, ip, kind), r in read(right).items():
        for t, d in increases(r):
            want[t // 3600 * 3600, ip, kind] += d
    got = {(r["timestamp"], r["ip"], r["list_type"]): r["count"] for r in sensors.sensor_facts(moved).collect()}
    assert got == {k: n for k, n in want.items() if n}


def test_lists_and_empty(spark):
    rows = [("a", 1, "x", 5), ("b", 1, "x", 100), ("a", 2, "x", 9), ("b", 2, "x", 3), ("a", 2, "x", 8)]
    schema = "sensor_id STRING, run_ts BIGINT, set_name STRING, packets BIGINT"
    out = sensors.sensor_list_delta(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, out)) == [(1, "a", "x", 5), (1, "b", "x", 100), (2, "a", "x", 4), (2, "b", "x", 3)]
    none = spark.createDataFrame([], SNAPSHOT)
    assert sensors.slot_totals(none).collect() == [] == sensors.sensor_facts(none).collect()


def test_windows_hold_one_day_of_a_key(spark, rows):
    """No window is partitioned by a key alone but over its one row per day."""
    plan = sensors.slot_totals(spark.createDataFrame(rows, SNAPSHOT))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_chunk#" in line for line in windows)
