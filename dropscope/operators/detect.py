"""Brute force, connection peaks and ban intervals.

One source may send a third of all packets, and a flood may put very many of them on one instant. So rows
first become one weighted row per source and instant (combined on the map side), and no window spans a
source's whole history: time is cut into slots, a window sees one source for one or two slots, and what a
slot needs from the rest arrives as one row per source and slot.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dropscope.config import DAY, Config
from dropscope.functions.times import floor_div
from dropscope.operators.holds import greedy_holds

US = 1000000


def trailing_sum(instants: DataFrame, key: list[str], ts: str, n: str, seconds: int) -> DataFrame:
    """``instants`` (unique per key and ``ts``) plus ``recent``: sum of ``n`` over the ``seconds`` up to and
    including each instant.

    The closed range [t - seconds, t] splits into the instant's own second, the whole seconds between, and
    the part of the second ``seconds`` earlier at or after the same offset. The first and last part come
    from one window per (key, second), at most two million instants; the middle comes from per-second
    totals, at most 2 * seconds of them.
    """
    sec = floor_div(ts, US)
    base = instants.select(*key, ts, n)

    totals = base.groupBy(*key, sec.alias("_sec")).agg(F.sum(n).alias("_n"))
    slots = totals.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "_slot", floor_div("_sec", seconds) + F.col("_copy")
    )
    span = W.partitionBy(*key, "_slot").orderBy("_sec").rangeBetween(-(seconds - 1), -1)
    middle = (
        slots.withColumn("_mid", F.coalesce(F.sum("_n").over(span), F.lit(0)))
        .filter(F.col("_copy") == 0)
        .select(*key, "_sec", "_mid")
    )

    # Own rows get even order numbers, rows of the second `seconds` earlier odd ones just above, so a
    # running sum up to an own row holds all own rows at or before it and only strictly earlier old ones.
    both = base.withColumn("_old", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        *key, ts, n, "_old", (sec + F.col("_old") * seconds).alias("_sec"), (F.pmod(ts, F.lit(US)) * 2 + F.col("_old")).alias("_ord")
    )
    second = W.partitionBy(*key, "_sec")
    run = second.orderBy("_ord").rangeBetween(W.unboundedPreceding, 0)
    own, old = F.col(n) * (1 - F.col("_old")), F.col(n) * F.col("_old")
    edge = F.sum(own).over(run) + F.sum(old).over(second) - F.sum(old).over(run)
    edges = both.withColumn("_edge", edge).filter(F.col("_old") == 0)
    return edges.join(middle, [*key, "_sec"]).select(*key, ts, n, (F.col("_edge") + F.col("_mid")).alias("recent"))


def trailing_count(
    rows: DataFrame, key: list[str], ts: str, seconds: int, at_least: int = 1
) -> DataFrame:
    """``rows`` plus ``recent``: rows of the same key in the ``seconds`` up to and including each row, for
    rows where that is ``at_least`` so many. Only the instants that qualify are joined back."""
    instants = rows.groupBy(*key, ts).agg(F.count("*").alias("_w"))
    found = trailing_sum(instants, key, ts, "_w", seconds).filter(F.col("recent") >= at_least)
    return rows.join(found.select(*key, ts, "recent"), [*key, ts]).select(*rows.columns, "recent")


def protected(packets: DataFrame, config: Config) -> DataFrame:
    """New connections to service ports that brute-force protection covers."""
    hit = F.lit(False)
    for proto in ("tcp", "udp"):
        ports = config.brute_ports(proto)
        if ports:
            hit = hit | ((F.col("proto") == proto) & F.col("dport").isin(*ports))
    return packets.filter((F.col("state") == "NEW") & hit)


def bruteforce_hits(packets: DataFrame, config: Config, ts: str = "ts_us") -> DataFrame:
    """New connections of sources that already made ``brute_hits`` in the last ``brute_seconds``.

    ``hits`` counts the earlier connections of the same source and protocol, over all protected ports.
    """
    rows = protected(packets, config).select("pkt_id", "src", "proto", ts)
    counted = trailing_count(rows, ["src", "proto"], ts, config.brute_seconds, config.brute_hits + 1)
    return counted.select("pkt_id", "src", "proto", ts, (F.col("recent") - 1).alias("hits"))


def _custom_port(conns: DataFrame, config: Config) -> Column:
    custom = F.lit(False)
    if "dport" in conns.columns:
        for proto, ports in (("tcp", config.bypass_conn_tcp), ("udp", config.bypass_conn_udp)):
            if ports:
                custom = custom | ((F.col("proto") == proto) & F.col("dport").isin(*ports))
    return F.when(custom, "custom").otherwise("default")


def busy_stretches(conns: DataFrame, slot_seconds: int = 10) -> DataFrame:
    """``src, start_us, busy``: the start of the stretch without an idle instant that each opening belongs to.

    Before a stretch begins, everything the source ever opened has ended, refused or not; so stretches decide about
    their connections independently. Latest ends and stretch starts run inside one source and slot; earlier
    slots come as one row each.
    """
    slot = floor_div("start_us", slot_seconds * US).alias("slot")
    opens = conns.groupBy("src", "start_us").agg(F.max("end_us").alias("e")).withColumn("slot", slot)
    inner = W.partitionBy("src", "slot").orderBy("start_us")
    before = W.partitionBy("src").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    ends = opens.groupBy("src", "slot").agg(F.max("e").alias("m")).withColumn("m", F.max("m").over(before))
    so_far = F.greatest("m", F.max("e").over(inner.rowsBetween(W.unboundedPreceding, -1)))
    fresh = F.when(F.col("so_far").isNull() | (F.col("so_far") <= F.col("start_us")), F.col("start_us"))
    marked = opens.join(ends, ["src", "slot"]).withColumn("so_far", so_far).select("src", "slot", "start_us", fresh.alias("b"))
    begun = marked.groupBy("src", "slot").agg(F.max("b").alias("m")).withColumn("m", F.max("m").over(before))
    busy = F.coalesce(F.max("b").over(inner.rowsBetween(W.unboundedPreceding, 0)), "m")
    return marked.join(begun, ["src", "slot"]).select("src", "start_us", busy.alias("busy"))


_ATTEMPT = "conn_id bigint, src string, port_class string, open bigint, allowed int"


def _admit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Greedy admission over rows sorted by (src, busy, start_us, conn_id): a heap of the ends of admitted connections."""
    stretch, ends = None, []
    for batch in batches:
        src, busy, start, end, allowed = (batch.column(c).to_pylist() for c in ("src", "busy", "start_us", "end_us", "allowed"))
        level = []
        for who, at, opens, closes, limit in zip(src, busy, start, end, allowed, strict=True):
            if (who, at) != stretch:
                stretch, ends = (who, at), []
            while ends and ends[0] <= opens:
                heappop(ends)
            level.append(len(ends) + 1)
            if limit is None or len(ends) < limit:
                heappush(ends, closes)
        cols = [batch.column("conn_id").cast(pa.int64()), batch.column("src"), batch.column("port_class"), pa.array(level, pa.int64())]
        yield pa.RecordBatch.from_arrays([*cols, batch.column("allowed")], names=["conn_id", "src", "port_class", "open", "allowed"])


def admissions(conns: DataFrame, config: Config, slot_seconds: int = 10) -> DataFrame:
    """Every opening in the order of (start, conn_id) with the connections then ``open``, itself included, and the
    number ``allowed`` (null: no limit): ``conn_id, src, port_class, open, allowed``.

    ``conns``: conn_id, src, start_us, end_us (exclusive) and optionally proto, dport. An opening over its limit is refused and
    does not count from then on. All admitted connections of a source count; the port being opened selects the
    limit (custom for bypass ports, where 0 means none). A stretch streams through a fold that holds the ends
    of admitted connections; a busy source is as many pieces as it has stretches. Rows without a start or end are ignored.
    """
    limit = F.when(F.col("port_class") == "default", config.conn_limit).otherwise(config.conn_limit_custom or None).cast("int")
    rows = conns.filter("start_us IS NOT NULL AND end_us IS NOT NULL AND src IS NOT NULL")
    keyed = rows.select("conn_id", "src", "start_us", "end_us", _custom_port(conns, config).alias("port_class"))
    keyed = keyed.join(busy_stretches(rows, slot_seconds), ["src", "start_us"]).withColumn("allowed", limit)
    order = ["src", "busy", "start_us", "conn_id"]
    return keyed.repartition("src", "busy").sortWithinPartitions(*order).mapInArrow(_admit, _ATTEMPT)


def _over() -> Column:
    return F.coalesce(F.col("open") > F.col("allowed"), F.lit(False))


def peak_connections(conns: DataFrame, config: Config, slot_seconds: int = 10) -> DataFrame:
    """Most connections a source tried to hold open at once, per port class: ``src, port_class, peak, allowed, over``.

    Refused openings count for themselves only, so ``peak`` is at most one over the limit (``allowed``, 0: none).
    """
    peaks = admissions(conns, config, slot_seconds).groupBy("src", "port_class", "allowed").agg(F.max("open").alias("peak"), F.max(_over()).alias("over"))
    return peaks.select("src", "port_class", "peak", F.coalesce("allowed", F.lit(0)).alias("allowed"), "over")


def over_limit_opens(conns: DataFrame, config: Config, slot_seconds: int = 10) -> DataFrame:
    """Refused openings: ``conn_id, src, open``."""
    return admissions(conns, config, slot_seconds).filter(_over()).select("conn_id", "src", "open")


def nth_previous(rows: DataFrame, key: list[str], ts: str, n: int, seconds: int) -> DataFrame:
    """Per key and instant, the times ``nth`` of the ``n``-th row before, where at most ``seconds`` back.

    Rows of one instant beyond ``n + 1`` have all their ``n`` predecessors on that instant and are
    predecessors in no other way than the ones kept, so an instant needs no more than ``n + 1`` rows. Time
    is cut into slots of ``seconds``: the row looked for is in the same slot or among the last ``n`` of the
    slot before, which are copied over.
    """
    instants = rows.groupBy(*key, ts).agg(F.least(F.count("*"), F.lit(n + 1)).cast("int").alias("_c"))
    each = instants.select(*key, ts, F.explode(F.sequence(F.lit(1), F.col("_c"))).alias("_i"))
    slotted = each.withColumn("_slot", floor_div(ts, seconds * US))
    cols = [*key, ts, "_i"]
    last = W.partitionBy(*key, "_slot").orderBy(F.col(ts).desc(), F.col("_i").desc())
    tails = slotted.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= n)
    carried = tails.select(*cols, (F.col("_slot") + 1).alias("_slot"), F.lit(True).alias("_copy"))
    both = slotted.select(*cols, "_slot", F.lit(False).alias("_copy")).unionByName(carried)
    order = W.partitionBy(*key, "_slot").orderBy(ts, "_i")
    out = both.withColumn("nth", F.lag(ts, n).over(order)).filter(~F.col("_copy"))
    return out.filter(F.col("nth") >= F.col(ts) - seconds * US).select(*key, ts, "nth")


def bruteforce_bans(packets: DataFrame, config: Config, ts: str = "ts_us") -> DataFrame:
    """Bans that brute force really opens: ``src, start_s, end_s``.

    While a source is banned its connections are dropped before they are counted, so after a ban the count
    starts anew: a hit opens the next ban only if the whole run of connections behind it came after the
    ban's end. Ends fall on whole seconds, so of all hits whose run began in the same second only the first
    can matter; that leaves one row per source and second, folded as in ``ban_intervals``.
    """
    rows = protected(packets, config).select("src", "proto", ts)
    hits = nth_previous(rows, ["src", "proto"], ts, config.brute_hits, config.brute_seconds)
    began, at = floor_div("nth", US).alias("free"), floor_div(ts, US)
    firsts = hits.groupBy("src", began).agg(F.min(at).alias("start"))
    if config.ban_timeout == 0:
        return firsts.groupBy("src").agg(F.min("start").alias("start_s"), F.lit(None).cast("long").alias("end_s"))
    # A run that began a little later may hit earlier: runs of the next seconds are seen from the day before as well.
    slots = F.array_distinct(F.array(floor_div("free", DAY), floor_div(F.col("free") - config.brute_seconds - 1, DAY)))
    near = W.partitionBy("src", "_slot").orderBy("free").rangeBetween(0, config.brute_seconds + 1)
    soonest = firsts.withColumn("_slot", F.explode(slots)).withColumn("start", F.min("start").over(near))
    soonest = soonest.filter(F.col("_slot") == floor_div("free", DAY))
    return greedy_holds(soonest.select("src", "free", "start", (F.col("start") + config.ban_timeout).alias("end")), ["src"])


def ban_intervals(offences: DataFrame, timeout: int = DAY, ts: str = "ts") -> DataFrame:
    """Bans opened by offences: ``src, start_s, end_s`` in whole seconds; hits during a ban do not extend it.

    ``timeout`` 0 is a permanent ban (``end_s`` null). Each ban depends on the one before; days of a source are
    folded side by side and chained (see ``holds``), so a busy source is many tasks. A day holds at most 86,400 distinct
    seconds of a source.
    """
    seconds = offences.select("src", F.col(ts).cast("long").alias("ts")).filter(F.col("ts").isNotNull())
    if timeout == 0:
        return seconds.groupBy("src").agg(F.min("ts").alias("start_s"), F.lit(None).cast("long").alias("end_s"))
    at = F.col("ts")
    return greedy_holds(seconds.select("src", at.alias("free"), at.alias("start"), (at + timeout).alias("end")), ["src"])


def bans_at(intervals: DataFrame, as_of: int) -> DataFrame:
    """Sources whose ban covers ``as_of``."""
    open_ = F.col("end_s").isNull() | (F.col("end_s") > as_of)
    return intervals.filter((F.col("start_s") <= as_of) & open_).select("src", "start_s", "end_s")
