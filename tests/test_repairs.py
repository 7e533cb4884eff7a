"""Cases that earlier versions got wrong."""

import time

import pytest
from pyspark.sql import functions as F

from dropscope.operators import abuse, flows
from dropscope.plans import refresh
from dropscope.sources import store as S
from dropscope.sources import text as T


def test_short_v6_source_survives(spark):
    line = "1704067207.179575 eth3 In IP6 2a::1.443 > 2001:db8::1.22: Flags [S], seq 1, win 1024, length 0"
    rows = T.parse_packets(spark.createDataFrame([(line,)], "line STRING")).collect()
    assert [(r["ip"], r["port"]) for r in rows] == [("2a::1", 22)]


def test_scan_of_all_ports_is_quick(spark):
    ports = spark.range(1, 65536)
    packets = ports.select(F.lit("198.51.0.1").alias("ip"), F.col("id").cast("int").alias("port"), F.lit("tcp").alias("proto"), F.col("id").alias("ts_us"))
    old = ports.agg(F.array_join(F.collect_list(F.concat(F.col("id"), F.lit("/udp"))), ",").alias("port_history"))
    info = old.select(F.lit("198.51.0.1").alias("ip"), "port_history")
    began = time.time()
    text = flows.merge_port_history(info, packets).first()["port_history"]
    assert len(text.split(",")) == 2 * 65535 and time.time() - began < 20


def test_upsert_takes_one_row_per_key(spark):
    schema = "ip STRING, last_sent BIGINT"
    target = spark.createDataFrame([("a", 1), ("b", 2)], schema)
    out = S.upsert(target, spark.createDataFrame([("a", 5), ("a", 9), ("c", None), ("c", 3)], schema), ["ip"])
    assert sorted(map(tuple, out.collect())) == [("a", 9), ("b", 2), ("c", 3)]


def test_lost_version_is_an_error(spark, tmp_path):
    store = str(tmp_path)
    assert S.load_store(spark, store)["ip_info"].count() == 0
    S.publish(spark.createDataFrame([("a", 1)], "ip STRING, last_sent BIGINT"), store, "abuse_reports")
    spark.sql(f"SELECT 2L AS version, 1L AS rows, 0L AS committed_at, '{store}/gone' AS path").write.mode("append").json(f"{store}/abuse_reports/versions")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.load_store(spark, store)["abuse_reports"].count()


def test_report_queue_prunes_facts(spark, tmp_path):
    """The scan for new hits starts at the day of the oldest report among the candidates."""
    store = str(tmp_path)
    rows = [(1706659200 - d * 86400, "198.51.0.1", 5, "trap") for d in range(40)]
    S.append_ip_drops(spark.createDataFrame(rows, "timestamp BIGINT, ip STRING, count BIGINT, list_type STRING"), store)
    cands = spark.createDataFrame([("198.51.0.1", 1706659200 - 3 * 86400)], "host STRING, last_sent BIGINT")
    hits = abuse.new_hits(cands, S.read_facts(spark, store, "ip_drops"), 1706659200 - 3 * 86400)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and hits.first()["new_hits"] == 15


def test_statistics_run_again_adds_nothing(spark, tmp_path):
    store = str(tmp_path)
    rules = lambda *r: spark.createDataFrame(r, "run_ts BIGINT, set_name STRING, packets BIGINT")
    snaps = lambda *r: spark.createDataFrame(r, "run_ts BIGINT, ip STRING, list_type STRING, packets BIGINT")
    first = rules((3600, "GeoBlock", 10)), snaps((3600, "a", "geo", 10), (3600, None, "geo", 4))
    second = rules((90000, "GeoBlock", 25), (93600, "GeoBlock", 5)), snaps((90000, "a", "geo", 17), (90000, "b", "geo", 1))
    for counters, readings in (first, first, second, first, second):
        refresh.statistics_run(spark, store, counters, readings, None, 0)
    got = {n: sorted((r["timestamp"], r["count"]) for r in S.load_store(spark, store)[n].collect()) for n in ("drops", "ip_drops")}
    assert got == {"drops": [(3600, 10), (90000, 15), (93600, 5)], "ip_drops": [(3600, 10), (90000, 1), (90000, 7)]}


def test_append_after_a_lost_run(spark, tmp_path):
    rows = spark.createDataFrame([(3600, "a", 5, "geo"), (200000, "a", 6, "geo")], S.table_schema("ip_drops"))
    S.append_facts(rows.limit(1), str(tmp_path), "ip_drops")
    S.append_once(rows, str(tmp_path), "ip_drops")
    assert S.read_facts(spark, str(tmp_path), "ip_drops").count() == 2


def test_daily_tier_is_read(spark, tmp_path):
    """Sums stay as they are for what is kept; later runs add days, late rows are neither lost nor counted twice."""
    store, noon, day = str(tmp_path), 1706616000, 86400
    rows = [(noon - d * day + k, "a", 10 + d, "trap") for d in range(6) for k in (0, 7)]
    schema = S.table_schema("ip_drops")
    total = lambda: S.load_store(spark, store)["ip_drops"].agg(F.sum("count")).first()[0]
    S.append_facts(spark.createDataFrame(rows, schema), store, "ip_drops")
    before = total()
    for as_of in (noon - 2 * day, noon, noon, noon - 3 * day):
        refresh.retention_run(spark, store, as_of)
        assert total() == before
    late = spark.createDataFrame([(noon - 5 * day, "b", 3, "geo")], schema)
    S.append_once(late, store, "ip_drops")
    S.append_once(late, store, "ip_drops")
    assert total() == before + 3
    refresh.retention_run(spark, store, noon + day)
    assert total() == before + 3
    assert S.read_versioned(spark, store, "ip_drops_daily").count() == 6  # the late row's day is in the tier
    plan = S.read_history(spark, store, "ip_drops")._jdf.queryExecution().executedPlan().toString()
    scans = [p.split("]")[0] for p in plan.split("PartitionFilters: [")[1:]]
    assert sum("event_date#" in p for p in scans) == sum("late#" in p for p in scans) - 1 == 1  # the tier has neither


def test_late_rows_age_with_their_days(spark, tmp_path):
    """A late row is counted at once, once, and goes by the rules of its day; so does one after a repeated run."""
    store, noon, day = str(tmp_path), 1706616000, 86400
    schema = S.table_schema("ip_drops")
    put = lambda *rows: S.append_facts(spark.createDataFrame(list(rows), schema), store, "ip_drops")
    have = lambda: sorted((r["ip"], r["count"]) for r in S.load_store(spark, store)["ip_drops"].groupBy("ip").agg(F.sum("count").alias("count")).collect())
    put(*[(noon - d * day, f"big{d}", 10_000 + d, "trap") for d in range(20)])
    refresh.retention_run(spark, store, noon)
    all_ = have()
    put((noon - 100 * day, "faint", 1, "geo"), (noon - 10 * day, "big10", 5, "trap"), (noon - 10 * day, "small", 2, "trap"))
    now = sorted([*[(i, n + 5 * (i == "big10")) for i, n in all_], ("faint", 1), ("small", 2)])
    assert have() == now
    refresh.retention_run(spark, store, noon)  # the same day: nothing moves
    assert have() == now
    for as_of in (noon + day, noon + 2 * day):
        refresh.retention_run(spark, store, as_of)
        assert have() == [x for x in now if x[0] != "faint"]
    refresh.retention_run(spark, store, noon + 25 * day)
    assert not {"faint", "small"} & {i for i, _ in have()}


def test_late_reading_before_a_restart(spark, tmp_path):
    """100, then 5 after a restart, then late 500 between them: 100, 400 and 5, however the runs are cut or repeated."""
    store = str(tmp_path)
    rules = spark.createDataFrame([], "run_ts BIGINT, set_name STRING, packets BIGINT")
    snaps = lambda *r: spark.createDataFrame(list(r), "run_ts BIGINT, ip STRING, list_type STRING, packets BIGINT")
    first = snaps((1000, "a", "geo", 100), (1000, "b", "geo", 1))
    second = snaps((9000, "a", "geo", 5), (9000, "b", "geo", 30))
    late = snaps((5000, "a", "geo", 500), (5000, "b", "geo", 30), (10, "a", "geo", 3))
    for readings in (first, second, second, late, late, first, second):
        refresh.statistics_run(spark, store, rules, readings, None, 0)
    rows = S.load_store(spark, store)["ip_drops"].groupBy("ip", "timestamp").agg(F.sum("count").alias("n")).filter("n <> 0").collect()
    assert {(r["ip"], r["timestamp"]): r["n"] for r in rows} == {("a", 1000): 100, ("a", 5000): 400, ("a", 9000): 5, ("b", 1000): 1, ("b", 5000): 29}
