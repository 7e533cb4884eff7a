"""Tiles of months and years against sums over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from dropscope.config import DAY, WINDOWS
from dropscope.operators import reports, retention, tiles
from dropscope.plans import refresh
from dropscope.sources import store as S

FACT = "timestamp long, ip string, count long, list_type string"


def rows_of(totals):
    return sorted(map(tuple, totals.select("ip", "list_type", *WINDOWS).collect()), key=str)


@pytest.mark.parametrize("as_of", [1706659200, 1704067200, 1704067200 + DAY, 1709208000, 1703980800 + 43200])
def test_totals_equal_those_over_days(spark, as_of):
    random.seed(as_of)
    edge = retention.closed_day(as_of)
    spread = [as_of - random.randrange(1200 * DAY) for _ in range(1500)]
    near = [as_of - s + d for s in WINDOWS.values() if s for d in (-1, 0, 1, -43200, 43200)]
    rows = [(t, f"9.9.9.{t % 3}", t % 7 - 1, random.choice(["main", "trap"])) for t in [*spread, *near, edge, edge - 1]]
    facts = spark.createDataFrame([*rows, rows[0]], FACT)
    daily, fresh = retention.rollup_ip_drops(facts, as_of), facts.filter(F.col("timestamp") >= edge)
    want = reports.window_totals(retention.compact(facts, ["ip", "list_type"], as_of), as_of)
    got = tiles.tiled_totals(fresh, daily, tiles.tile_sums(daily, edge), as_of, edge)
    assert rows_of(got) == rows_of(want)


def test_no_day_of_a_whole_month_is_read_for_all_history(spark):
    as_of = 1706659200
    cover = tiles.Cover.of(as_of, None, retention.closed_day(as_of))
    days = spark.range(0, 1500).select((F.lit(as_of // DAY * DAY + 43200) - F.col("id") * DAY).alias("timestamp"))
    assert days.filter(cover.days()).filter("timestamp < 1704067200").count() == 0
    year = tiles.Cover.of(as_of, WINDOWS["1y"], retention.closed_day(as_of))
    # The day of the window's first second on, to the end of that month, and the open month.
    assert days.filter(year.days()).filter("timestamp < 1704067200").count() == 1


def test_calendar_is_utc_whatever_the_session(spark):
    ts = [0, -1, 1704067199, 1704067200, 1709164800]
    df = spark.createDataFrame([(t,) for t in ts], "t long").select("t", *[tiles.tile_start("t", g).alias(g) for g in ("month", "year")])
    want = sorted((t, tiles._floor(t, "month"), tiles._floor(t, "year")) for t in ts)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert sorted(map(tuple, df.collect())) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_empty_inputs(spark):
    none = spark.createDataFrame([], FACT)
    sums = tiles.tile_sums(none, 1706572800)
    assert sums.count() == 0
    assert tiles.tiled_totals(none, none, sums, 1706659200, 1706572800).count() == 0


def test_store_reads_tiles_only_of_its_own_tier(spark, tmp_path):
    store, as_of = str(tmp_path), 1706659200
    facts = spark.createDataFrame([(as_of - d * DAY, f"9.9.9.{d % 2}", 10 + d, "main") for d in range(0, 800, 3)], FACT)
    S.append_ip_drops(facts, store)
    S.append_drops(facts.select("timestamp", F.lit("AutoBan").alias("list_name"), "count"), store)
    for run in (as_of - 40 * DAY, as_of):
        refresh.retention_run(spark, store, run)
    late = spark.createDataFrame([(as_of - 90 * DAY, "9.9.9.1", 77, "main")], FACT)
    S.append_ip_drops(late, store)
    want = rows_of(reports.window_totals(S.read_history(spark, store, "ip_drops"), as_of))
    plan = S.stored_totals(spark, store, as_of)
    assert rows_of(plan) == want
    assert "ip_drops_tiles" in "".join(plan.inputFiles())
    # A tier whose tiles are missing, as after a lost run, is read by days; the next run adds the tiles.
    S.publish_tier(S.read_versioned(spark, store, "ip_drops_daily"), store, "ip_drops", as_of + DAY)
    plan = S.stored_totals(spark, store, as_of + DAY)
    assert "ip_drops_tiles" not in "".join(plan.inputFiles())
    refresh.retention_run(spark, store, as_of + DAY)
    plan = S.stored_totals(spark, store, as_of + DAY)
    assert "ip_drops_tiles" in "".join(plan.inputFiles())
    assert rows_of(plan) == rows_of(reports.window_totals(S.read_history(spark, store, "ip_drops"), as_of + DAY))
