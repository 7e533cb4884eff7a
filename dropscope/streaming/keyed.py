"""Streams with keyed state and event-time timers.

Rows may come in any order within a stated lateness. A row waits in its key's state until the watermark passes it, then the
key's rows are folded in time order, so results are final and equal the batch operator's; nothing taken before
is read again. What a key no longer needs leaves the state: waiting rows once folded, an ended ban by a timer, a counter by its
time to live. Rows behind the watermark come out as ``kind = 'late'`` with what they held; ``merge_late`` lets a
batch job put right the keys they belong to.

State is kept in RocksDB, which the jobs set for their session, and checkpointed with the query. A call serves the keys of one of
``BUCKETS`` buckets and holds their carried values and waiting rows: those of the lateness and of one batch, and for brute force the
times of one span. Where one source sends so much that these do not fit a task, use the forms in ``jobs``, which split a source.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from dropscope.config import Config
from dropscope.operators import deltas, detect


# Fixed value: Spark's own provider class.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Keys that share a state entry; part of a checkpoint, so it stays for a stream's life.
BUCKETS = 1024
_TYPES = {"BIGINT": T.LongType(), "INT": T.IntegerType(), "STRING": T.StringType(), "ARRAY<BIGINT>": T.ArrayType(T.LongType())}


def shape(fields: str) -> T.StructType:
    """Schema from ``name TYPE, ...``, without a session: workers have none."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split(" ") for f in fields.split(", "))])


class InOrder(StatefulProcessor):
    """Holds rows back until the watermark has passed them, then folds them in the order of ``row`` columns.

    The first of the columns is the time in units of 1 / ``scale`` milliseconds. Subclasses fold one row of a key into the
    key's carried value and say when a carried value has no more use. A call serves all keys of one bucket: the state
    is read and written as lists, a few calls a bucket and batch whatever the rows and keys.
    """

    keys = ""
    row = ""
    carry = ""
    out = ""
    scale = 1.0  # milliseconds per unit of time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", shape(f"{self.keys}, {self.row}"))
        self.carried = handle.getListState("carried", shape(f"{self.keys}, {self.carry}"))
        self.names = shape(f"{self.keys}, {self.row}").names
        self.width = len(shape(self.keys).names)
        self.served = set()  # buckets folded in this batch

    def ms(self, at: int) -> int:
        return int(at * self.scale)

    def start(self) -> tuple:
        raise NotImplementedError

    def seen(self, rows: list[tuple]) -> None:
        """All waiting rows of a key, before those behind the watermark are folded."""

    def fold(self, carried: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def spent(self, carried: tuple) -> int | None:
        """Time from which ``carried`` equals no state at all; None: never."""
        return None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark, w = timerValues.getCurrentWatermarkInMs(), self.width
        soonest = None
        for pdf in rows:
            new = list(pdf[self.names].drop_duplicates().itertuples(index=False, name=None))
            late = [r for r in new if self.ms(r[w]) < mark]
            fresh = [r for r in new if self.ms(r[w]) >= mark]
            if fresh:
                self.waiting.appendList(fresh)
                first = min(r[w] for r in fresh)
                soonest = first if soonest is None else min(soonest, first)
            yield from self._frames(late, "late")
        if soonest is not None:
            self.handle.registerTimer(self.ms(soonest) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Several timers of a bucket may end in one batch; the first does all that the watermark has passed.
        if key in self.served:
            return
        self.served.add(key)
        mark, w = timerValues.getCurrentWatermarkInMs(), self.width
        carried = {tuple(r)[:w]: tuple(r)[w:] for r in self.carried.get()}
        out, left = [], []
        for name, group in groupby(sorted({tuple(r) for r in self.waiting.get()}), key=lambda r: r[:w]):
            rows = [r[w:] for r in group]
            done = [r for r in rows if self.ms(r[0]) < mark]
            left.extend((*name, *r) for r in rows[len(done) :])
            if done:
                self.seen(rows)
                value = carried.get(name) or self.start()
                for row in done:
                    value, more = self.fold(value, row)
                    out.extend((*name, *r) for r in more)
                carried[name] = value
        ends = {name: self.spent(value) for name, value in carried.items()}
        carried = {n: value for n, value in carried.items() if ends[n] is None or self.ms(ends[n]) >= mark}
        self._put(self.waiting, left)
        self._put(self.carried, [(*n, *value) for n, value in carried.items()])
        due = [r[w] for r in left] + [ends[n] for n in carried if ends[n] is not None]
        if due:
            self.handle.registerTimer(self.ms(min(due)) + 1)
        yield from self._frames(out, "result")

    def _put(self, state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def _frames(self, rows: list[tuple], kind: str) -> Iterator[pd.DataFrame]:
        """Rows in the output's shape, none for no rows: columns a late row lacks are null."""
        if not rows:
            return
        names = shape(self.out).names
        have = dict(zip(self.names if kind == "late" else names[1:], zip(*rows, strict=True), strict=True))
        have["kind"] = [kind] * len(rows)
        text = {"kind", *self.names[: self.width]}
        none = [None] * len(rows)
        yield pd.DataFrame({c: pd.Series(list(have.get(c, none)), dtype=object if c in text else "Int64") for c in names})

    def close(self) -> None:
        pass


class Bans(InOrder):
    """Offences open a ban while none runs; an ended ban leaves the state."""

    keys, row, carry = "src STRING", "ts BIGINT", "free BIGINT"
    out = "kind STRING, src STRING, ts BIGINT, start_s BIGINT, end_s BIGINT"
    scale = 1000.0

    def __init__(self, timeout: int):
        self.timeout = timeout

    def start(self) -> tuple:
        return (None,)

    def fold(self, carried, row):
        (free,), (ts,) = carried, row
        if free is not None and (self.timeout == 0 or ts < free):
            return carried, []
        return (ts + self.timeout,), [(None, ts, ts + self.timeout if self.timeout else None)]

    def spent(self, carried):
        return None if self.timeout == 0 or carried[0] is None else carried[0]


class Counters(InOrder):
    """Increase of every reading over the one before; a fall is a restart from 0."""

    keys, row, carry = "ip STRING, list_type STRING", "run_ts BIGINT, packets BIGINT", "before BIGINT"
    out = "kind STRING, ip STRING, list_type STRING, run_ts BIGINT, packets BIGINT, count BIGINT"
    scale = 1000.0

    def start(self) -> tuple:
        return (0,)

    def fold(self, carried, row):
        (before,), (run_ts, packets) = carried, row
        increase = packets if packets < before else packets - before
        return (packets,), [(run_ts, packets, increase)] if increase > 0 else []


class Bruteforce(InOrder):
    """Connections with ``hits`` or more before them in ``span`` microseconds.

    The carried value is the list of times still inside the span; rows of one instant count for each other.
    """

    keys, row, carry = "src STRING, proto STRING", "ts_us BIGINT, pkt_id BIGINT", "recent ARRAY<BIGINT>"
    out = "kind STRING, src STRING, proto STRING, ts_us BIGINT, pkt_id BIGINT, hits BIGINT"
    scale = 0.001

    def __init__(self, seconds: int, hits: int):
        self.span, self.hits = seconds * detect.US, hits

    def start(self) -> tuple:
        return ([],)

    def seen(self, rows):
        self.now = Counter(ts for ts, _ in rows)

    def fold(self, carried, row):
        (recent,), (ts, pkt_id) = carried, row
        recent = [t for t in recent if t >= ts - self.span]
        # Rows of this instant are counted together; those folded before are in the list already.
        together = len(recent) + self.now[ts] - sum(t == ts for t in recent) - 1
        return ([*recent, ts],), [(ts, pkt_id, together)] if together >= self.hits else []

    def spent(self, carried):
        return carried[0][-1] + self.span if carried[0] else None


def _keyed(rows: DataFrame, at: str, unit: Callable, processor: InOrder, lateness: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # The processor tells late rows itself: it gets the plain number, which no watermark filter drops.
    timed = rows.withColumn("_at", unit(at)).withWatermark("_at", lateness).drop("_at")
    bucket = F.pmod(F.xxhash64(*shape(processor.keys).names), F.lit(BUCKETS))
    return timed.withColumn("_bucket", bucket).groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=shape(processor.out), outputMode="Append", timeMode="EventTime"
    )


def keyed_bans(offences: DataFrame, timeout: int, lateness: str = "1 hour") -> DataFrame:
    """Ban intervals of an offence stream (src, ts in seconds): ``kind, src, ts, start_s, end_s``."""
    rows = offences.select("src", F.col("ts").cast("bigint").alias("ts")).filter("src IS NOT NULL AND ts IS NOT NULL")
    return _keyed(rows, "ts", F.timestamp_seconds, Bans(timeout), lateness)


def keyed_deltas(snapshots: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Positive increases of a snapshot stream: ``kind, ip, list_type, run_ts, packets, count``."""
    rows = snapshots.select("ip", "list_type", "run_ts", "packets").filter("ip IS NOT NULL AND list_type IS NOT NULL AND run_ts IS NOT NULL AND packets IS NOT NULL")
    return _keyed(rows, "run_ts", F.timestamp_seconds, Counters(), lateness)


def keyed_bruteforce(packets: DataFrame, config: Config, lateness: str = "1 minute") -> DataFrame:
    """Brute-force hits of a packet stream: ``kind, src, proto, ts_us, pkt_id, hits``. Packets need distinct ``pkt_id``."""
    rows = detect.protected(packets, config).select("src", "proto", "ts_us", "pkt_id").filter("src IS NOT NULL AND ts_us IS NOT NULL AND pkt_id IS NOT NULL")
    return _keyed(rows, "ts_us", F.timestamp_micros, Bruteforce(config.brute_seconds, config.brute_hits), lateness)


def to_tables(results: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """Sink of a keyed stream: one folder per kind under ``out``, each batch committed once."""
    writer = results.writeStream.format("parquet").outputMode("append").partitionBy("kind")
    return writer.option("path", out).option("checkpointLocation", checkpoint)


def read_kind(spark: SparkSession, out: str, processor_out: str, kind: str) -> DataFrame:
    rows = spark.read.schema(shape(processor_out)).parquet(out)
    return rows.filter(F.col("kind") == kind).drop("kind")


def merge_late(results: DataFrame, late: DataFrame, stored: DataFrame, key: list[str], batch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results with late rows counted: keys that have some are computed again by the ``batch`` operator from their
    ``stored`` rows (late ones included); results of all other keys are kept."""
    hit = late.select(*key).distinct()
    again = batch(stored.join(hit, key, "left_semi"))
    return results.join(hit, key, "left_anti").unionByName(again.select(*results.columns))


def merged_bans(results: DataFrame, late: DataFrame, offences: DataFrame, timeout: int) -> DataFrame:
    kept = results.select("src", "start_s", "end_s")
    return merge_late(kept, late, offences, ["src"], lambda rows: detect.ban_intervals(rows, timeout))


def merged_deltas(results: DataFrame, late: DataFrame, snapshots: DataFrame) -> DataFrame:
    kept = results.select("run_ts", "ip", "count", "list_type")
    return merge_late(kept, late, snapshots, ["ip", "list_type"], lambda rows: deltas.ip_delta(rows))
