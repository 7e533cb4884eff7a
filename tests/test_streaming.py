"""A stream read in several micro-batches gives what the batch operator gives on all rows."""

import pytest
from pyspark.sql import functions as F

from catalog.views import AS_OF, Views
from catalog.aggregates import PACKET_CFG
from dropscope.operators import deltas, detect, flows, netsets
from dropscope.sources import store as S
from dropscope.sources import text as T
from dropscope.streaming import jobs as J

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def v(spark):
    return Views(spark, SF)


def feed(df, order, path, parts=4):
    """``df`` as a stream of ``parts`` micro-batches in time order."""
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    width = (hi - lo) // parts + 1
    for i in range(parts):
        part = df.filter(F.floor((F.col(order) - lo) / width) == i)
        part.coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def bag(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def batches(spark, out):
    return J.read_output(spark, out).select("batch").distinct().count()


def test_flows(spark, v, tmp_path):
    lines = v.packet_text.join(v.packets.select("pkt_id", "ts_us"), "pkt_id").orderBy("ts_us")
    stream = feed(lines, "ts_us", f"{tmp_path}/in").drop("ts_us")
    q = J.stream_flows(stream, "1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/out")
    J.run_available(q.option("checkpointLocation", f"{tmp_path}/c"))
    cols = ("ip", "port", "proto")
    assert bag(spark.read.parquet(f"{tmp_path}/out"), *cols) == bag(flows.distinct_flows(T.parse_packets(v.packet_text)), *cols)


def test_counter_delta(spark, v, tmp_path):
    stream = feed(v.set_snapshots, "run_ts", f"{tmp_path}/in")
    J.run_available(J.stream_counter_delta(stream, f"{tmp_path}/out", f"{tmp_path}/c"))
    cols = ("run_ts", "ip", "count", "list_type")
    assert batches(spark, f"{tmp_path}/out") == 4
    assert bag(J.read_output(spark, f"{tmp_path}/out"), *cols) == bag(deltas.ip_delta(v.set_snapshots), *cols)


def test_bruteforce(spark, v, tmp_path):
    stream = feed(v.packets, "ts_us", f"{tmp_path}/in")
    J.run_available(J.stream_bruteforce(stream, PACKET_CFG, f"{tmp_path}/out", f"{tmp_path}/c"))
    cols = ("pkt_id", "src", "proto", "ts_us", "hits")
    want = bag(detect.bruteforce_hits(v.packets, PACKET_CFG), *cols)
    assert want and bag(J.read_output(spark, f"{tmp_path}/out"), *cols) == want


@pytest.mark.parametrize("timeout", [0, 200000])
def test_bans(spark, v, tmp_path, timeout):
    trap = v.ip_drops.filter("list_type = 'trap'").select(F.col("ip").alias("src"), F.col("timestamp").alias("ts"))
    stream = feed(trap, "ts", f"{tmp_path}/in")
    J.run_available(J.stream_bans(stream, f"{tmp_path}/out", f"{tmp_path}/c", timeout))
    cols = ("src", "start_s", "end_s")
    assert bag(J.read_output(spark, f"{tmp_path}/out"), *cols) == bag(detect.ban_intervals(trap, timeout), *cols)


def test_port_history(spark, v, tmp_path):
    packets = T.parse_packets(v.packet_text)
    store = f"{tmp_path}/store"
    S.publish(v.ip_info, store, "ip_info", AS_OF)
    stream = feed(packets, "ts_us", f"{tmp_path}/in", parts=2)
    J.run_available(J.stream_port_history(stream, store, f"{tmp_path}/c", AS_OF))
    got = {r.ip: (r.target_port, set(r.port_history.split(","))) for r in S.read_versioned(spark, store, "ip_info").collect()}
    want = {r.ip: (r.target_port, set(r.port_history.split(","))) for r in flows.apply_port_history(v.ip_info, packets, AS_OF).collect()}
    assert got == want


def test_log_scan_reports_an_address_once(spark, v, tmp_path):
    stream = feed(v.log_lines, "line_no", f"{tmp_path}/in")
    J.run_available(J.stream_log_scan(stream, v.net_set, f"{tmp_path}/out", f"{tmp_path}/c"))
    want = bag(netsets.new_attackers(T.attacker_ips(v.log_lines), v.net_set), "ip", "status")
    assert bag(J.read_output(spark, f"{tmp_path}/out"), "ip", "status") == want


def test_live_top5_last_refresh(spark, v, tmp_path):
    stream = feed(v.ip_drops, "timestamp", f"{tmp_path}/in")
    J.run_available(J.stream_live_top5(stream, v.ip_info, f"{tmp_path}/out", f"{tmp_path}/c"))
    rows = J.read_output(spark, f"{tmp_path}/out")
    last = rows.agg(F.max("batch")).first()[0]
    want = v.ip_drops.groupBy("ip").agg(F.sum("count").alias("delta")).orderBy(F.desc("delta"), "ip").limit(5)
    assert bag(rows.filter(F.col("batch") == last), "ip", "delta") == bag(want, "ip", "delta")


def in_files(df, path, parts):
    """Rows with ``part`` as a stream of one file a micro-batch."""
    for i in range(parts):
        df.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_late_counters(spark, tmp_path):
    rows = [(0, "a", 10, 100), (0, "b", 10, 7), (1, "a", 30, 5), (2, "a", 20, 500), (2, "b", 20, 9), (3, "a", 5, 60), (3, "b", 30, 9)]
    df = spark.createDataFrame([(p, i, "trap", t, n) for p, i, t, n in rows], "part INT, ip STRING, list_type STRING, run_ts BIGINT, packets BIGINT")
    J.run_available(J.stream_counter_delta(in_files(df, f"{tmp_path}/in", 4), f"{tmp_path}/out", f"{tmp_path}/c"))
    cols = ("run_ts", "ip", "count", "list_type")
    assert bag(J.read_output(spark, f"{tmp_path}/out"), *cols) == bag(deltas.ip_delta(df.drop("part")), *cols)


def test_late_packets_and_a_clock_far_ahead(spark, tmp_path):
    n, second = PACKET_CFG.brute_hits + 2, 1_000_000
    at = [(0, "a", i) for i in range(n - 1)] + [(0, "ahead", 10**6)] + [(1, "a", n), (2, "a", 0), (2, "ahead", 5), (3, "a", 1)]
    at += [(1 + i % 3, "ahead", 6 + i) for i in range(n)]
    proto, port = next((p, PACKET_CFG.brute_ports(p)[0]) for p in ("tcp", "udp") if PACKET_CFG.brute_ports(p))
    rows = [(p, i, s, proto, port, "NEW", t * second) for i, (p, s, t) in enumerate(at)]
    df = spark.createDataFrame(rows, "part INT, pkt_id BIGINT, src STRING, proto STRING, dport INT, state STRING, ts_us BIGINT")
    J.run_available(J.stream_bruteforce(in_files(df, f"{tmp_path}/in", 4), PACKET_CFG, f"{tmp_path}/out", f"{tmp_path}/c"))
    cols = ("pkt_id", "src", "proto", "ts_us", "hits")
    want = bag(detect.bruteforce_hits(df.drop("part"), PACKET_CFG), *cols)
    assert {r[1] for r in want} == {"a", "ahead"} and bag(J.read_output(spark, f"{tmp_path}/out"), *cols) == want


@pytest.mark.parametrize("timeout", [0, 1000])
def test_late_offences(spark, tmp_path, timeout):
    rows = [(0, "a", 1000), (1, "a", 500), (1, "a", 9000), (2, "a", 1600), (2, "b", 3), (3, "a", 1), (3, "a", 8500), (3, "b", 1)]
    df = spark.createDataFrame(rows, "part INT, src STRING, ts BIGINT")
    J.run_available(J.stream_bans(in_files(df, f"{tmp_path}/in", 4), f"{tmp_path}/out", f"{tmp_path}/c", timeout))
    cols = ("src", "start_s", "end_s")
    assert bag(J.read_output(spark, f"{tmp_path}/out"), *cols) == bag(detect.ban_intervals(df.drop("part"), timeout), *cols)


def test_late_flows_come_once(spark, tmp_path):
    day = 86400
    rows = [(0, 10 * day, "1.2.3.4"), (1, 20 * day, "1.2.3.5"), (2, 21 * day, "1.2.3.4"), (3, 2 * day, "1.2.3.6")]
    text = "{} IP {}.4000 > 10.0.0.1.22: Flags [S], length 0"
    df = spark.createDataFrame([(p, text.format(f"{t}.000000", ip)) for p, t, ip in rows], "part INT, line STRING")
    want = bag(flows.distinct_flows(T.parse_packets(df)), "ip", "port", "proto")
    q = J.stream_flows(in_files(df, f"{tmp_path}/in", 4)).writeStream.format("parquet").option("path", f"{tmp_path}/out")
    J.run_available(q.option("checkpointLocation", f"{tmp_path}/c"))
    assert len(want) == 3 and bag(spark.read.parquet(f"{tmp_path}/out"), "ip", "port", "proto") == want
