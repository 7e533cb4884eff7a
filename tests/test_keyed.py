"""Keyed streams with timers, fed in four files with rows out of order, against the batch operators."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dropscope.config import Config
from dropscope.operators import deltas, detect
from dropscope.streaming import jobs as J
from dropscope.streaming import keyed as K
from tests.test_streaming import bag, in_files


def run(spark, results, processor, path):
    J.run_available(K.to_tables(results, f"{path}/out", f"{path}/c"))
    return [K.read_kind(spark, f"{path}/out", processor.out, kind) for kind in ("result", "late")]


@pytest.mark.parametrize("timeout", [0, 1000])
def test_bans(spark, tmp_path, timeout):
    """Rows at most an hour late, then one far too late; a last row moves the watermark past all others."""
    rows = [(0, "a", 5000), (0, "b", 5500), (1, "a", 4500), (1, "a", 7000), (2, "a", 5600), (2, "c", 4000), (3, "a", 7900), (3, "b", 7400), (3, "z", 90_000), (4, "b", 10), (4, "z", 95_000)]
    df = spark.createDataFrame(rows, "part INT, src STRING, ts BIGINT")
    got, late = run(spark, K.keyed_bans(in_files(df, f"{tmp_path}/in", 5), timeout), K.Bans, tmp_path)
    assert bag(late, "src", "ts") == [("b", 10)]
    cols = ("src", "start_s", "end_s")
    in_time = detect.ban_intervals(df.filter("ts > 10 AND src <> 'z'"), timeout)
    assert bag(got.filter("src <> 'z'"), *cols) == bag(in_time, *cols)
    merged = K.merged_bans(got.filter("src <> 'z'"), late, df.filter("src <> 'z'"), timeout)
    assert bag(merged, *cols) == bag(detect.ban_intervals(df.filter("src <> 'z'"), timeout), *cols)


def test_counters(spark, tmp_path):
    """A reading before a restart that comes late changes two increases; a far too late one goes to the side."""
    rows = [(0, "a", 5000, 100), (0, "b", 5000, 7), (1, "a", 7000, 5), (1, "b", 6000, 9), (2, "a", 6000, 500), (2, "b", 7000, 9), (3, "a", 4500, 60), (3, "z", 90_000, 1), (4, "b", 10, 3), (4, "z", 95_000, 2)]
    df = spark.createDataFrame([(p, i, "trap", t, n) for p, i, t, n in rows], "part INT, ip STRING, list_type STRING, run_ts BIGINT, packets BIGINT")
    got, late = run(spark, K.keyed_deltas(in_files(df, f"{tmp_path}/in", 5)), K.Counters, tmp_path)
    assert bag(late, "ip", "run_ts", "packets") == [("b", 10, 3)]
    cols = ("run_ts", "ip", "count", "list_type")
    own = F.col("ip") != "z"
    assert bag(got.filter(own), *cols) == bag(deltas.ip_delta(df.filter(own & (F.col("run_ts") > 10))), *cols)
    assert bag(K.merged_deltas(got.filter(own), late, df.filter(own)), *cols) == bag(deltas.ip_delta(df.filter(own)), *cols)


def test_bruteforce(spark, tmp_path):
    config, second = Config(tcp_services=(22,), brute_hits=3, brute_seconds=10), 1_000_000
    at = [(0, "a", 100), (0, "a", 101), (1, "a", 103), (1, "a", 112), (2, "a", 102), (2, "a", 104), (3, "a", 104), (3, "b", 90), (3, "z", 900), (4, "z", 901)]
    rows = [(p, i, s, "tcp", 22, "NEW", t * second) for i, (p, s, t) in enumerate(at)]
    df = spark.createDataFrame(rows, "part INT, pkt_id BIGINT, src STRING, proto STRING, dport INT, state STRING, ts_us BIGINT")
    got, late = run(spark, K.keyed_bruteforce(in_files(df, f"{tmp_path}/in", 5), config), K.Bruteforce, tmp_path)
    cols = ("pkt_id", "src", "proto", "ts_us", "hits")
    want = bag(detect.bruteforce_hits(df.filter("src <> 'z'"), config), *cols)
    assert want and bag(got, *cols) == want and late.isEmpty()


def test_state_calls_follow_buckets_not_rows():
    """A bucket's rows are taken and folded with as many state calls for 4 keys of 500 rows as for one row, and once a batch."""
    calls = []

    class State:
        def __init__(self):
            self.rows = []

        def get(self):
            calls.append("get")
            return iter(self.rows)

        def put(self, rows):
            calls.append("put")
            self.rows = list(rows)

        def appendList(self, rows):
            calls.append("append")
            self.rows += rows

        def clear(self):
            calls.append("clear")
            self.rows = []

    class Handle:
        def getListState(self, name, schema):
            return State()

        def registerTimer(self, ms):
            calls.append("timer")

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    def serve(rows):
        calls.clear()
        counters = K.Counters()
        counters.init(Handle())
        assert not list(counters.handleInputRows((1,), iter([pd.DataFrame(rows, columns=["ip", "list_type", "run_ts", "packets"])]), At(0)))
        out = [f for _ in range(3) for f in counters.handleExpiredTimer((1,), At(10**9), None)]
        return len(calls), sum(map(len, out))

    one, found = serve([("a", "trap", 1, 5)])
    assert found == 1 and serve([(ip, "trap", t, t) for ip in "abcd" for t in range(1, 501)]) == (one, 2000)
