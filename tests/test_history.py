"""Port sightings merged at read against the batch form."""

from pyspark.sql import functions as F

from dropscope.operators import flows
from dropscope.sources import store as S
from dropscope.streaming import history as H
from dropscope.streaming.jobs import run_available

INFO = "ip STRING, country STRING, risk INT, domain STRING, updated BIGINT, target_port INT, port_history STRING"
PACKET = "ts_us BIGINT, ip STRING, port INT, proto STRING"
BATCHES = [
    [(50, "a", 22, "tcp"), (60, "a", 23, "tcp"), (60, "x", 9, "udp")],
    [(10, "a", 80, "tcp"), (70, "b", 53, "udp"), (70, "b", 52, "udp"), (1, None, 5, "tcp")],
    [(55, "a", 22, "tcp"), (20, "b", 1, "tcp"), (5, "x", 8, "tcp")],
    [(60, "a", 99, "udp")] * 500,
]


def feed(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, PACKET).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(PACKET).option("maxFilesPerTrigger", 1).parquet(path)


def bag(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_details_are_the_batch_form_at_every_cut(spark, tmp_path):
    info = spark.createDataFrame([("a", "DE", 1, "d", 7, 1, "80/tcp,7/udp"), ("b", None, 2, "e", 8, None, None), ("c", "FR", 3, "f", 9, 4, "4/tcp")], INFO)
    packets = spark.createDataFrame([r for b in BATCHES for r in b], PACKET)
    want = bag(flows.apply_port_history(info, packets, 1000))
    store, source, check = (str(tmp_path / x) for x in ("store", "in", "check"))
    S.publish(info, store, "ip_info")
    assert bag(H.read_details(spark, store)) == bag(info) and H.compact(spark, store) == -1
    for n in range(len(BATCHES)):
        run_available(H.stream_port_changes(feed(spark, source, BATCHES[n : n + 1]), store, check, 1000))
        seen = spark.createDataFrame([r for b in BATCHES[: n + 1] for r in b], PACKET)
        assert bag(H.read_details(spark, store)) == bag(flows.apply_port_history(info, seen, 1000))
        # A batch writes its own distinct sightings and no version of the details.
        written = spark.read.parquet(f"{store}/{H.CHANGES}/batch={n}").count()
        assert written == len({r[1:] for r in BATCHES[n] if r[1]}) and S.current_version(spark, store, "ip_info") == 1
        if n % 2:
            assert H.compact(spark, store) == n - 1
            assert bag(H.read_details(spark, store)) == bag(flows.apply_port_history(info, seen, 1000))
    assert H.compact(spark, store, through=3) == 3 == H.compact(spark, store)
    assert bag(H.read_details(spark, store)) == want
    merged = S.read_versioned(spark, store, H.MERGED)
    assert {r["ip"] for r in merged.collect()} == {"a", "b"} and merged.count() == 7

    # Details published from a fold take the same sightings again without a change.
    S.publish(H.read_details(spark, store), store, "ip_info", 1000)
    assert bag(H.read_details(spark, store)) == want


def test_compacted_batches_are_pruned(spark, tmp_path):
    store = str(tmp_path / "store")
    S.publish(spark.createDataFrame([("a", "DE", 1, "d", 7, 1, "")], INFO), store, "ip_info")
    run_available(H.stream_port_changes(feed(spark, str(tmp_path / "in"), BATCHES), store, str(tmp_path / "check"), 5))
    H.compact(spark, store, through=2)
    left = H._pending(spark, store, H.compacted_through(spark, store))
    assert len(left.inputFiles()) >= 1 and {r[0] for r in left.select("batch").distinct().collect()} == {3}
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan
    assert H.read_details(spark, store).agg(F.max("updated")).first()[0] == 7
