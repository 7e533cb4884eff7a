"""Streaming jobs.

Row-local work and windowed sums use Spark's own streaming operators. Where a step needs what came
before (last counters, recent packets, open bans), the job applies the batch operator to each
micro-batch plus a small carried table, so results equal the batch form and hot sources are split the
same way. The carried table of batch n is written once under its batch number on the shared store and
only read by batch n + 1; a replayed batch reads the same input and overwrites the same output.

Rows may come in any order. Keys with a row older than what they carry are computed again from the stored
rows of all batches, from that row on; results of earlier batches that no longer hold are withdrawn.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.utils import AnalysisException

from dropscope.config import Config
from dropscope.functions.times import floor_div
from dropscope.operators import deltas, detect, flows, netsets, reports
from dropscope.operators.reports import SERIES_COLUMNS
from dropscope.sources import store as S
from dropscope.sources import text as X


def run_available(writer: DataStreamWriter) -> StreamingQuery:
    """Process what has arrived, then stop: the unit a scheduler starts every 30 or 60 minutes."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


class Carried:
    """Table handed from one micro-batch to the next."""

    def __init__(self, path: str, schema: str):
        self.path, self.schema = path, schema

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(f"{self.path}/batch={batch_id - 1}")

    def save(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")


class Taken:
    """All rows a job has taken, under their batch numbers; read for keys with late rows only."""

    def __init__(self, path: str, schema: str):
        self.path, self.schema = path, schema

    def save(self, df: DataFrame, batch_id: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        return df.sparkSession.read.schema(self.schema).parquet(f"{self.path}/batch={batch_id}")

    def until(self, spark: SparkSession, batch_id: int) -> DataFrame:
        rows = spark.read.schema(f"{self.schema}, batch INT").parquet(self.path)
        return rows.filter(F.col("batch") <= batch_id).drop("batch")


def _emit(df: DataFrame, out: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


def _without(rows: DataFrame, gone: DataFrame, *when: Column) -> DataFrame:
    """``rows`` without those equal to a row of ``gone`` in its columns ``_gone_...``."""
    same = [F.col(c.removeprefix("_gone_")).eqNullSafe(F.col(c)) for c in gone.columns if c.startswith("_gone_")]
    return rows.join(gone, [*same, *when], "left_anti")


def read_output(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """All batches a job has written (those ``before`` a batch), without what later ones have withdrawn."""
    earlier = F.lit(True) if before is None else F.col("batch") < before
    rows = spark.read.parquet(out).filter(earlier)
    try:
        gone = spark.read.parquet(f"{out}-withdrawn")
    except AnalysisException:
        return rows
    gone = gone.filter(earlier).withColumnRenamed("batch", "_until")
    return _without(rows, gone, F.col("batch") < F.col("_until"))


def _revise(fresh: DataFrame, right: DataFrame, given: DataFrame, out: str, batch_id: int) -> None:
    """Emit ``fresh``, and of ``right`` what is not among the earlier results ``given``; withdraw the rest of ``given``."""
    right, given = right.select(*fresh.columns), given.select(*fresh.columns)
    gone = given.exceptAll(right).distinct().toDF(*[f"_gone_{c}" for c in fresh.columns])
    _emit(gone, f"{out}-withdrawn", batch_id)
    gone = fresh.sparkSession.read.schema(gone.schema).parquet(f"{out}-withdrawn/batch={batch_id}")
    _emit(fresh.unionByName(right.exceptAll(_without(given, gone))), out, batch_id)


def _each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def stream_flows(lines: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Distinct (ip, port, proto) of a capture-text stream, each once, however late its packets are.

    The state holds every flow met and no packet is too late, so ``delay`` bounds nothing; it stays for callers.
    """
    packets = X.parse_packets(lines).withColumn("ts", F.timestamp_micros("ts_us"))
    return packets.dropDuplicates(["ip", "port", "proto"])


def stream_port_history(packets: DataFrame, store: str, checkpoint: str, as_of: int) -> DataStreamWriter:
    """Merge every micro-batch of packets (ts_us, ip, port, proto) into the stored details table.

    Merging the same packets twice changes nothing, so a replayed batch is harmless.
    """

    def step(batch: DataFrame, _: int) -> None:
        info = S.read_versioned(batch.sparkSession, store, "ip_info")
        S.publish(flows.apply_port_history(info, batch, as_of), store, "ip_info", as_of)

    return _each_batch(packets, step, checkpoint)


def stream_counter_delta(snapshots: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """Positive counter increases of a snapshot stream: ``run_ts, ip, count, list_type``.

    The carried table is the last reading per key, about one snapshot.
    """
    key, cols = ["ip", "list_type"], ["ip", "list_type", "run_ts", "packets"]
    schema = "ip STRING, list_type STRING, run_ts BIGINT, packets BIGINT"
    last, taken = Carried(f"{out}-state", schema), Taken(f"{out}-taken", schema)

    def increases(rows: DataFrame) -> DataFrame:
        rows = rows.filter(F.col("delta") > 0)
        return rows.select("run_ts", "ip", F.col("delta").alias("count"), "list_type")

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = last.before(spark, batch_id).select(*cols)
        new = taken.save(batch.select(*cols), batch_id)
        seen = old.select(*key, F.col("run_ts").alias("_seen"))
        firsts = new.groupBy(*key).agg(F.min("run_ts").alias("_first"))
        late = firsts.join(seen, key).filter("_first <= _seen").select(*key, "_first")
        both = old.withColumn("_old", F.lit(True)).unionByName(new.withColumn("_old", F.lit(False)))
        fresh = increases(deltas.counter_delta(both.join(late, key, "left_anti"), key).filter(~F.col("_old")))
        if late.isEmpty():
            _emit(fresh, out, batch_id)
        else:
            rows = deltas.counter_delta(taken.until(spark, batch_id).join(late, key), key)
            given = read_output(spark, out, batch_id).join(late, key).filter("run_ts >= _first")
            _revise(fresh, increases(rows.filter("run_ts >= _first")), given, out, batch_id)
        newest = both.groupBy(*key).agg(F.max(F.struct("run_ts", "packets")).alias("m"))
        last.save(newest.select(*key, "m.run_ts", "m.packets"), batch_id)

    return _each_batch(snapshots, step, checkpoint)


def stream_live_top5(hits: DataFrame, ip_info: DataFrame, out: str, checkpoint: str, n: int = 5) -> DataStreamWriter:
    """Largest sources since the session began, refreshed per trigger: ``batch, ip, delta, country, severity``.

    A trigger gets the new sums of the sources it changed. As sums only grow (``count`` is not negative), a source outside the last
    list and unchanged stays behind those on it, so the list follows from the last one and the changed sources;
    the carried table has ``n`` rows.
    """
    from dropscope.functions.text import severity_band

    sums = hits.groupBy("ip").agg(F.sum("count").alias("delta"))
    listed = Carried(f"{out}-state", "ip STRING, delta BIGINT")

    def step(batch: DataFrame, batch_id: int) -> None:
        old = listed.before(batch.sparkSession, batch_id).select("ip", "delta")
        both = batch.select("ip", "delta").unionByName(old).groupBy("ip").agg(F.max("delta").alias("delta"))
        listed.save(reports.top_n(both, "delta", ["ip"], n), batch_id)
        top = listed.before(batch.sparkSession, batch_id + 1).select("ip", "delta")
        _emit(reports.with_country(top, ip_info).withColumn("severity", severity_band("delta")), out, batch_id)

    return _each_batch(sums, step, checkpoint).outputMode("update")


def stream_bruteforce(packets: DataFrame, config: Config, out: str, checkpoint: str) -> DataStreamWriter:
    """Brute-force hits of a packet stream, as in the batch detector.

    The carried table holds, per source and protocol, the protected connections of the ``brute_seconds`` before the
    newest one, so a clock far ahead concerns its own source only.
    """
    schema = "pkt_id BIGINT, src STRING, proto STRING, ts_us BIGINT"
    recent, taken = Carried(f"{out}-state", schema), Taken(f"{out}-taken", schema)
    names, key, span = ["pkt_id", "src", "proto", "ts_us"], ["src", "proto"], config.brute_seconds * detect.US

    def hits(rows: DataFrame) -> DataFrame:
        counted = detect.trailing_count(rows, key, "ts_us", config.brute_seconds, config.brute_hits + 1)
        return counted.withColumn("hits", F.col("recent") - 1)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = recent.before(spark, batch_id).withColumn("_carried", F.lit(True))
        new = taken.save(detect.protected(batch, config).select(*names), batch_id).withColumn("_carried", F.lit(False))
        both = old.unionByName(new)
        seen = old.groupBy(*key).agg(F.max("ts_us").alias("_seen"))
        firsts = new.groupBy(*key).agg(F.min("ts_us").alias("_first"))
        # A connection of the same instant counts for the ones carried.
        late = firsts.join(seen, key).filter("_first <= _seen").select(*key, "_first")
        fresh = hits(both.join(late, key, "left_anti")).filter(~F.col("_carried")).select(*names, "hits")
        if late.isEmpty():
            _emit(fresh, out, batch_id)
        else:
            rows = taken.until(spark, batch_id).join(late, key).filter(F.col("ts_us") >= F.col("_first") - span)
            given = read_output(spark, out, batch_id).join(late, key).filter("ts_us >= _first")
            _revise(fresh, hits(rows).filter("ts_us >= _first"), given, out, batch_id)
        top = both.groupBy(*key).agg(F.max("ts_us").alias("_top"))
        kept = both.join(top, key).filter(F.col("ts_us") >= F.col("_top") - span)
        recent.save(kept.select(*names), batch_id)

    return _each_batch(packets, step, checkpoint)


def stream_bans(offences: DataFrame, out: str, checkpoint: str, timeout: int) -> DataStreamWriter:
    """Ban intervals of an offence stream (src, ts in seconds); 0 is permanent.

    The carried table is the last ban per source. Offences during it open nothing; one before it can move the
    source's bans from there on.
    """
    last = Carried(f"{out}-state", "src STRING, start_s BIGINT, end_s BIGINT")
    taken = Taken(f"{out}-taken", "src STRING, ts BIGINT")
    newest = F.max(F.struct("start_s", "end_s")).alias("m")

    def free(rows: DataFrame, bans: DataFrame) -> DataFrame:
        rows = rows.join(bans, "src", "left").filter(F.col("start_s").isNull() | (F.col("ts") >= F.col("end_s")))
        return detect.ban_intervals(rows.select("src", "ts"), timeout)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = last.before(spark, batch_id)
        new = taken.save(batch.select("src", F.col("ts").cast("bigint").alias("ts")).filter("ts IS NOT NULL").distinct(), batch_id)
        firsts = new.groupBy("src").agg(F.min("ts").alias("_first"))
        late = firsts.join(old, "src").filter("_first < start_s").select("src", "_first")
        fresh = free(new.join(late, "src", "left_anti"), old)
        if late.isEmpty():
            _emit(fresh, out, batch_id)
        else:
            given = read_output(spark, out, batch_id).join(late, "src")
            before = given.filter("start_s < _first").groupBy("src").agg(newest).select("src", "m.*")
            rows = taken.until(spark, batch_id).join(late, "src").filter("ts >= _first")
            _revise(fresh, free(rows, before), given.filter("start_s >= _first"), out, batch_id)
        # Stored first: the emitted rows and the carried rows come from one computation.
        made = read_output(spark, out, batch_id + 1)
        changed = made.filter(F.col("batch") == batch_id) if late.isEmpty() else made.join(late, "src", "left_semi").unionByName(made.filter(F.col("batch") == batch_id))
        kept = changed.select("src", "start_s", "end_s").unionByName(old.join(late, "src", "left_anti"))
        last.save(kept.groupBy("src").agg(newest).select("src", "m.start_s", "m.end_s"), batch_id)

    return _each_batch(offences, step, checkpoint)


def stream_series(drops: DataFrame, grain: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Drops per tumbling window (``ts`` TIMESTAMP, list_name, count); a window closes ``delay`` after its end."""
    sums = []
    for name, lists in SERIES_COLUMNS.items():
        hit = F.when(F.col("list_name").isin(lists), F.col("count")).otherwise(0)
        sums.append(F.sum(hit).alias(name))
    rows = drops.withWatermark("ts", delay).groupBy(F.window("ts", grain))
    out = rows.agg(*sums, F.sum("count").alias("total"))
    return out.select(F.unix_timestamp("window.start").alias("start_s"), *SERIES_COLUMNS, "total")


def stream_series_sums(drops: DataFrame, out: str, checkpoint: str, grain: int = 3600) -> DataStreamWriter:
    """Partial sums per window of ``grain`` seconds (``ts`` TIMESTAMP, list_name, count), one set per batch.

    There is no state and no row is too late: a late row adds a partial sum to its window, and a replayed batch
    overwrites its own. ``read_series`` adds the sums up.
    """
    sums = [F.sum(F.when(F.col("list_name").isin(lists), F.col("count")).otherwise(0)).alias(name) for name, lists in SERIES_COLUMNS.items()]

    def step(batch: DataFrame, batch_id: int) -> None:
        start = (floor_div(F.unix_timestamp("ts"), grain) * grain).alias("start_s")
        _emit(batch.filter("ts IS NOT NULL").groupBy(start).agg(*sums, F.sum("count").alias("total")), out, batch_id)

    return _each_batch(drops, step, checkpoint)


def read_series(spark: SparkSession, out: str) -> DataFrame:
    """Windows as of all batches: ``start_s``, the series columns and ``total``."""
    columns = [*SERIES_COLUMNS, "total"]
    return spark.read.parquet(out).groupBy("start_s").agg(*[F.sum(c).alias(c) for c in columns])


def compact_series(spark: SparkSession, out: str, into: str) -> None:
    """All batches as one, in a new folder that readers may switch to."""
    _emit(read_series(spark, out), into, 0)


def stream_log_scan(lines: DataFrame, net_set: DataFrame | Callable[[], DataFrame], out: str, checkpoint: str) -> DataStreamWriter:
    """Status of every attacking address of a log stream, reported once: ``ip, status``.

    The carried table lists addresses already reported, so a later batch skips them. A function as ``net_set`` is called in
    every batch and so gives the sets then current, for instance ``membership.live_at`` over the newest version.
    """
    known = Carried(f"{out}-state", "ip STRING")

    def step(batch: DataFrame, batch_id: int) -> None:
        old = known.before(batch.sparkSession, batch_id)
        ips = X.attacker_ips(batch).join(old, "ip", "left_anti")
        _emit(netsets.new_attackers(ips, net_set() if callable(net_set) else net_set), out, batch_id)
        made = batch.sparkSession.read.parquet(f"{out}/batch={batch_id}")
        known.save(old.unionByName(made.select("ip")), batch_id)

    return _each_batch(lines, step, checkpoint)


def live_offences(hits: DataFrame) -> DataFrame:
    """Brute-force hits as ban offences."""
    return hits.select("src", floor_div("ts_us", detect.US).alias("ts"))


def current_sets(spark: SparkSession, store: str, name: str) -> DataFrame | None:
    """Published version of a set for a stream-static join, None before the first publication."""
    try:
        return S.read_versioned(spark, store, f"set_{name}")
    except AnalysisException:
        return None
