"""Streaming queries: each reads the given event table as a stream and returns what its sink holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.aggregates import BRUTE, BANS, DELTA, PACKET_CFG, SUMS
from catalog.joins import QUAD
from catalog.registry import hits, query
from catalog.sources import MERGED, PACKETS
from catalog.views import AS_OF, Views
from dropscope.sources import store as S
from dropscope.sources import text as X
from dropscope.streaming import history as H
from dropscope.streaming import jobs as J
from dropscope.streaming import keyed as K


def _live(v) -> Views:
    """The views over the event table read as a stream."""
    schema = v.events.schema
    stream = v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(v.sf_dir)
    return Views(v.spark, v.sf_dir, events=stream)


def _paths(v) -> tuple[str, str]:
    base = S.scratch_dir(v.spark)
    return f"{base}/out", f"{base}/checkpoint"


def _to_files(df: DataFrame, v) -> DataFrame:
    out, check = _paths(v)
    schema = df.schema
    J.run_available(df.writeStream.format("parquet").option("path", out).option("checkpointLocation", check))
    return v.spark.read.schema(schema).parquet(out)


def _in_files(df: DataFrame, v, at: str, lateness: int, parts: int = 4) -> DataFrame:
    """``df`` as a stream of ``parts`` files in the order of ``at``, one a trigger; a third of the rows of the last ``lateness`` units
    before each cut come with the next file."""
    low, high = df.agg(F.min(at), F.max(at)).first()
    step = max(1, (high - low) // parts + 1)
    place = F.floor((F.col(at) - low) / step)
    late = ((F.col(at) - low) % step >= step - lateness) & (F.pmod(F.xxhash64(*df.columns), F.lit(3)) == 0)
    path = S.scratch_dir(v.spark)
    dealt = df.withColumn("_part", F.least(place + late.cast("int"), F.lit(parts - 1)))
    dealt.repartition(parts, "_part").write.partitionBy("_part").parquet(f"{path}-dealt")
    for i in range(parts):
        # One file a part, written in order: the stream takes older files first.
        v.spark.read.schema(df.schema).parquet(f"{path}-dealt/_part={i}").coalesce(1).write.mode("append").parquet(path)
    return v.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _keyed(results: DataFrame, processor, v) -> DataFrame:
    out, check = _paths(v)
    J.run_available(K.to_tables(results, out, check))
    return K.read_kind(v.spark, out, processor.out, "result")


@query(
    "keyed_bans",
    """WITH RECURSIVE all_ AS (SELECT DISTINCT ip AS src, timestamp AS ts FROM fw_ip_drops WHERE list_type='trap'),
offs AS (SELECT * FROM all_ WHERE ts < (SELECT max(ts) FROM all_) - 86400), """
    + BANS.replace("{t}", "86400"),
)
def keyed_bans(v):
    """Bans from four files with rows up to a day late: all that the watermark has passed."""
    trap = v.ip_drops.filter(F.col("list_type") == "trap").select(F.col("ip").alias("src"), F.col("timestamp").alias("ts"))
    return _keyed(K.keyed_bans(_in_files(trap, v, "ts", 86400), 86400, "1 day"), K.Bans, v).select("src", "start_s", "end_s")


@query("keyed_deltas", f"WITH {DELTA} SELECT run_ts, ip, delta AS count, list_type FROM e WHERE delta > 0 AND run_ts < (SELECT max(run_ts) FROM fw_set_snapshots) - 86400")
def keyed_deltas(v):
    stream = _in_files(v.set_snapshots.select("ip", "list_type", "run_ts", "packets"), v, "run_ts", 86400)
    return _keyed(K.keyed_deltas(stream, "1 day"), K.Counters, v).select("run_ts", "ip", "count", "list_type")


@query("keyed_bruteforce", f"WITH {BRUTE} SELECT pkt_id, src, proto, ts_us, hits FROM br WHERE ts_us // 1000 < (SELECT max(ts_us) FROM fw_packets WHERE state='NEW' AND proto IN ('tcp','udp') AND dport IN (22,443,51515)) // 1000 - 30000")
def keyed_bruteforce(v):
    stream = _in_files(v.packets, v, "ts_us", 30_000_000)
    out = _keyed(K.keyed_bruteforce(stream, PACKET_CFG, "30 seconds"), K.Bruteforce, v)
    return out.select("pkt_id", "src", "proto", "ts_us", "hits")


@query("stream_flows", f"WITH {PACKETS} SELECT DISTINCT ip, port, proto FROM packets")
def stream_flows(v):
    return _to_files(J.stream_flows(_live(v).packet_text).select("ip", "port", "proto"), v)


@query(
    "stream_port_history",
    MERGED
    + """ SELECT i.ip, CASE WHEN m.ip IS NULL THEN i.target_port ELSE m.last_port END AS target_port,
 CASE WHEN m.ip IS NULL THEN i.port_history ELSE array_to_string(m.hist,',') END AS port_history FROM fw_ip_info i LEFT JOIN m ON m.ip=i.ip""",
)
def stream_port_history(v):
    out, check = _paths(v)
    S.publish(v.ip_info, out, "ip_info", AS_OF)
    J.run_available(J.stream_port_history(X.parse_packets(_live(v).packet_text), out, check, AS_OF))
    return S.read_versioned(v.spark, out, "ip_info").select("ip", "target_port", "port_history")


@query(
    "port_changes",
    MERGED
    + """ SELECT i.ip, CAST(CASE WHEN m.ip IS NULL THEN i.updated ELSE 1706659200 END AS BIGINT) AS updated,
 CASE WHEN m.ip IS NULL THEN i.target_port ELSE m.last_port END AS target_port,
 CASE WHEN m.ip IS NULL THEN i.port_history ELSE array_to_string(m.hist,',') END AS port_history FROM fw_ip_info i LEFT JOIN m ON m.ip=i.ip""",
)
def port_changes(v):
    """Sightings from four files with late rows; two batches are compacted, two merged at read."""
    out, check = _paths(v)
    S.publish(v.ip_info, out, "ip_info", AS_OF)
    packets = X.parse_packets(v.packet_text).select("ts_us", "ip", "port", "proto")
    J.run_available(H.stream_port_changes(_in_files(packets, v, "ts_us", 86400 * 1000000), out, check, AS_OF))
    H.compact(v.spark, out, through=1)
    return H.read_details(v.spark, out).select("ip", "updated", "target_port", "port_history")


@query("stream_counter_delta", f"WITH {DELTA} SELECT run_ts, ip, delta AS count, list_type FROM e WHERE delta > 0")
def stream_counter_delta(v):
    out, check = _paths(v)
    v.set_snapshots.write.parquet(f"{out}-in")
    stream = v.spark.readStream.schema(v.set_snapshots.schema).parquet(f"{out}-in")
    J.run_available(J.stream_counter_delta(stream, out, check))
    return J.read_output(v.spark, out).select("run_ts", "ip", "count", "list_type")


@query(
    "stream_live_top5",
    """WITH d AS (SELECT ip, CAST(sum(count) AS BIGINT) AS delta FROM fw_ip_drops GROUP BY ip ORDER BY delta DESC, ip LIMIT 5)
SELECT d.ip, d.delta, coalesce(i.country,'--') AS country, CASE WHEN delta > 100 THEN 'red' WHEN delta > 20 THEN 'yellow' ELSE 'green' END AS severity FROM d LEFT JOIN fw_ip_info i ON i.ip=d.ip""",
)
def stream_live_top5(v):
    out, check = _paths(v)
    hits = _in_files(v.ip_drops.select("ip", "count", "timestamp"), v, "timestamp", 86400)
    J.run_available(J.stream_live_top5(hits, v.ip_info, out, check))
    rows = J.read_output(v.spark, out)
    newest = rows.agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(newest), "batch", "left_semi").select("ip", "delta", "country", "severity")


@query("stream_bruteforce", f"WITH {BRUTE} SELECT pkt_id, src, proto, ts_us, hits FROM br")
def stream_bruteforce(v):
    out, check = _paths(v)
    J.run_available(J.stream_bruteforce(_live(v).packets, PACKET_CFG, out, check))
    return J.read_output(v.spark, out).select("pkt_id", "src", "proto", "ts_us", "hits")


@query(
    "stream_bans",
    "WITH RECURSIVE offs AS (SELECT DISTINCT ip AS src, timestamp AS ts FROM fw_ip_drops WHERE list_type='trap'), " + BANS.replace("{t}", "86400"),
)
def stream_bans(v):
    out, check = _paths(v)
    trap = _live(v).ip_drops.filter(F.col("list_type") == "trap")
    J.run_available(J.stream_bans(trap.select(F.col("ip").alias("src"), F.col("timestamp").alias("ts")), out, check, 86400))
    return J.read_output(v.spark, out).select("src", "start_s", "end_s")


@query(
    "stream_series",
    f"""WITH w AS (SELECT *, timestamp - timestamp % 86400 AS start_s FROM fw_ip_drops)
SELECT CAST(start_s AS BIGINT) AS start_s, {SUMS} FROM w WHERE start_s + 86400 <= (SELECT max(timestamp) FROM w) - 3600 GROUP BY start_s""",
)
def stream_series(v):
    """Closed days only: a window is emitted once the watermark has passed its end."""
    rows = _live(v).ip_drops.select(F.timestamp_seconds("timestamp").alias("ts"), "list_name", "count")
    return _to_files(J.stream_series(rows, "1 day", "1 hour"), v)


@query(
    "stream_series_sums",
    f"WITH w AS (SELECT *, timestamp - timestamp % 86400 AS start_s FROM fw_ip_drops) SELECT CAST(start_s AS BIGINT) AS start_s, {SUMS} FROM w GROUP BY start_s",
)
def stream_series_sums(v):
    """Every window, from four files of which each has rows of the days before."""
    out, check = _paths(v)
    rows = v.ip_drops.select("timestamp", "list_name", "count", F.timestamp_seconds("timestamp").alias("ts"))
    J.run_available(J.stream_series_sums(_in_files(rows, v, "timestamp", 5 * 86400), out, check, 86400))
    return J.read_series(v.spark, out)


@query(
    "stream_log_scan",
    rf"""WITH atk AS (SELECT DISTINCT unnest(regexp_extract_all(line,'{QUAD}')) AS ip FROM fw_log_lines WHERE regexp_matches(line,'TLS handshake failed|Bad encapsulated packet length')),
{hits('atk', 'fw_net_set')}
SELECT a.ip, CASE WHEN bool_or(h.set_name='FirewallBlock') THEN 'global' WHEN bool_or(h.set_name='VPNBlock') THEN 'already' ELSE 'new' END AS status
FROM a LEFT JOIN h ON h.ip=a.ip GROUP BY a.ip""",
)
def stream_log_scan(v):
    out, check = _paths(v)
    J.run_available(J.stream_log_scan(_live(v).log_lines, v.net_set, out, check))
    return J.read_output(v.spark, out).select("ip", "status")
