"""Aggregations, series, top lists, reports, windows."""

from __future__ import annotations

import dataclasses
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.registry import query
from catalog.joins import CLASSIFY, PACKET_CFG
from catalog.sources import PORT_ROWS
from catalog.views import AS_OF
from dropscope.config import Config
from dropscope.operators import abuse, classify, deltas, detect, reports, retention, sensors, tiles
from dropscope.plans import period, refresh
from dropscope.sources import store as S
from dropscope.sources import text as T

CFG = Config()
LABELS = {
    "hourly": ("strftime(make_timestamp(timestamp*1000000),'%H:00')", "WHERE timestamp >= 1706659200-86400"),
    "daily": ("strftime(make_timestamp(timestamp*1000000),'%d-%m-%Y')", "WHERE timestamp >= 1706659200-2592000"),
    # 12 calendar months before 2024-01-31
    "monthly": ("strftime(make_timestamp(timestamp*1000000),'%m-%Y')", "WHERE timestamp >= epoch(TIMESTAMP '2023-01-31')"),
    "yearly": ("strftime(make_timestamp(timestamp*1000000),'%Y')", ""),
}


def _sum(cond: str) -> str:
    return f"CAST(sum(CASE WHEN list_name IN ({cond}) THEN count ELSE 0 END) AS BIGINT)"


SUMS = ", ".join(
    f"{_sum(c)} AS {n}"
    for n, c in {
        "main": "'FirewallBlock'",
        "v6": "'FirewallBlock6'",
        "vpn": "'VPNBlock'",
        "trap": "'AutoBan','AutoBan6'",
        "geo": "'GeoBlock','GeoBlock6'",
    }.items()
) + ", CAST(sum(count) AS BIGINT) AS total"


def _series(grain: str) -> None:
    label, where = LABELS[grain]

    @query(
        f"series_{grain}",
        f"SELECT {label} AS label, {SUMS}, CAST(max(timestamp) AS BIGINT) AS newest FROM fw_drops {where} GROUP BY 1",
    )
    def series(v):
        return reports.order_series(reports.drop_series(v.drops, grain, AS_OF))

    @query(
        f"avg_per_{grain}",
        f"SELECT '{grain}' AS grain, CAST(round_even(coalesce(avg(t),0),0) AS BIGINT) AS average FROM (SELECT sum(count) AS t FROM fw_drops {where} GROUP BY {label}) x",
    )
    def average(v):
        return reports.avg_per_bucket(v.drops, grain, AS_OF)


for g in LABELS:
    _series(g)


@query(
    "avg_per_bucket",
    " UNION ALL ".join(
        f"SELECT '{k}' AS grain, CAST(round_even(coalesce(avg(t),0),0) AS BIGINT) AS average FROM (SELECT sum(count) AS t FROM fw_drops {w} GROUP BY {lab}) x{k}"
        for k, (lab, w) in LABELS.items()
    ),
)
def avg_per_bucket(v):
    """All four averages from one summary of the facts."""
    base = reports.condense(v.drops, AS_OF)
    return reduce(DataFrame.unionByName, [reports.avg_per_bucket(base, k, AS_OF) for k in LABELS])


@query(
    "series_hourly_ts",
    f"SELECT CAST(timestamp - timestamp % 3600 AS BIGINT) AS hour_ts, {SUMS} FROM fw_drops WHERE timestamp >= 1706659200-86400 GROUP BY 1",
)
def series_hourly_ts(v):
    return reports.series_hourly_ts(v.drops, AS_OF)


@query(
    "series_condensed",
    f"SELECT {LABELS['daily'][0]} AS label, {SUMS}, CAST(max(timestamp) AS BIGINT) AS newest FROM fw_drops {LABELS['daily'][1]} GROUP BY 1",
)
def series_condensed(v):
    """The daily series read from the lossless summary instead of the raw rows."""
    return reports.drop_series(reports.condense(v.drops, AS_OF), "daily", AS_OF)


@query(
    "top_days",
    f"SELECT {LABELS['daily'][0]} AS label, {SUMS}, CAST(max(timestamp) AS BIGINT) AS newest FROM fw_drops GROUP BY 1 ORDER BY total DESC, label LIMIT 10",
)
def top_days(v):
    return reports.top_days(v.drops)


@query("lifetime_drops", "SELECT CAST(coalesce(sum(count),0) AS BIGINT) AS total FROM fw_drops")
def lifetime_drops(v):
    return reports.lifetime_drops(v.drops)


@query(
    "top_ips",
    """WITH w(win,secs) AS (VALUES ('24h',86400),('30d',2592000),('1y',31536000),('all',NULL)),
f(family) AS (VALUES ('trap'),('hosts'),('nets'),('geo'),('ipv6')),
s AS (SELECT family, win, ip, CAST(sum(count) AS BIGINT) AS total, max(list_type) AS list_type FROM fw_ip_drops d JOIN w ON secs IS NULL OR timestamp > 1706659200-secs
 JOIN f ON CASE family WHEN 'trap' THEN list_type='trap' WHEN 'hosts' THEN list_type='main' AND NOT contains(ip,'/') WHEN 'nets' THEN list_type='main' AND contains(ip,'/') WHEN 'geo' THEN list_type='geo' ELSE contains(ip,':') END
 GROUP BY ALL)
SELECT family, win AS "window", ip, total, list_type, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY family, win ORDER BY total DESC, ip) AS rank FROM s) t WHERE rank<=10""",
)
def top_ips(v):
    return reports.top_ips(v.ip_drops, AS_OF)


DAYS = """days AS (SELECT timestamp - timestamp % 86400 + 43200 AS t, ip, list_type, sum(count) AS n FROM fw_ip_drops WHERE timestamp < 1706572800 GROUP BY 1,2,3)"""


@query(
    "window_tiles",
    f"""WITH {DAYS}, g(grain, until) AS (VALUES ('month', 1704067200), ('year', 1704067200))
SELECT grain, CAST(epoch(date_trunc(grain, make_timestamp(t*1000000))) AS BIGINT) AS start, ip, list_type, CAST(sum(n) AS BIGINT) AS count
FROM days JOIN g ON t < until GROUP BY ALL""",
)
def window_tiles(v):
    return tiles.tile_sums(retention.rollup_ip_drops(v.ip_drops, AS_OF), retention.closed_day(AS_OF))


@query(
    "tiled_totals",
    f"""WITH {DAYS}, w(win,secs) AS (VALUES ('24h',86400),('30d',2592000),('1y',31536000),('all',NULL)),
r AS (SELECT t, ip, list_type, n FROM days UNION ALL SELECT timestamp, ip, list_type, count FROM fw_ip_drops WHERE timestamp >= 1706572800)
SELECT ip, list_type, win AS "window", CAST(sum(n) AS BIGINT) AS total FROM r JOIN w ON secs IS NULL OR t > 1706659200-secs GROUP BY ALL""",
)
def tiled_totals(v):
    """Trailing windows from years, months, days and raw rows, long form."""
    daily, edge = retention.rollup_ip_drops(v.ip_drops, AS_OF), retention.closed_day(AS_OF)
    fresh = v.ip_drops.filter(F.col("timestamp") >= edge)
    return reports.long_totals(tiles.tiled_totals(fresh, daily, tiles.tile_sums(daily, edge), AS_OF, edge))


def _ports_check(where: str) -> str:
    return f"""WITH {PORT_ROWS}, x AS (SELECT * FROM r WHERE {where}),
g AS (SELECT win, full_port, CAST(count(DISTINCT ip) AS BIGINT) AS ips, CAST(sum(count) AS BIGINT) AS total, list_sort(list(DISTINCT ip)) AS l FROM x GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY total DESC, full_port) AS rk FROM g)
SELECT win AS "window", CAST(rk AS INT) AS rank, full_port, ips, total, array_to_string(l[1:3],', ') AS preview, CAST(greatest(ips-3,0) AS BIGINT) AS more FROM k WHERE rk<=10"""


@query("port_stats", _ports_check("true"))
def port_stats(v):
    out = reports.port_stats(v.ip_drops, v.ip_info, AS_OF)
    return out


@query(
    "bruteforce_stats",
    _ports_check(
        "list_type='trap' AND ((target_port IN (22,443) AND list_contains(string_split(port_history,','), concat(target_port,'/tcp'))) OR (target_port IN (53,51515) AND list_contains(string_split(port_history,','), concat(target_port,'/udp'))))"
    ),
)
def bruteforce_stats(v):
    return reports.bruteforce_stats(v.ip_drops, v.ip_info, CFG.tcp_services, CFG.udp_services, AS_OF)


@query(
    "ips_preview",
    f"""WITH {PORT_ROWS}, l AS (SELECT win, full_port, list_sort(list(DISTINCT ip)) AS l, row_number() OVER (PARTITION BY win ORDER BY sum(count) DESC, full_port) AS k FROM r GROUP BY win, full_port QUALIFY k <= 10)
SELECT win AS "window", full_port, array_to_string(l[1:3],', ') AS preview, CAST(greatest(len(l)-3,0) AS BIGINT) AS more FROM l""",
)
def ips_preview(v):
    """The shown addresses of every port table."""
    return reports.port_stats(v.ip_drops, v.ip_info, AS_OF).select("window", "full_port", "preview", "more")


# ---- deltas, sizes, trends ------------------------------------------------------------------------

RC = r"""rc AS (SELECT run_ts, set_name, CAST(sum(p) AS BIGINT) AS packets FROM (SELECT run_ts, chain, regexp_extract(line,'match-set (\w+)',1) AS set_name,
 arg_min(CAST(regexp_extract(line,'^\s*(\d+)',1) AS BIGINT), line_no) AS p FROM fw_rule_lines WHERE contains(line,'match-set') GROUP BY ALL) t GROUP BY ALL),
runs AS (SELECT DISTINCT run_ts FROM rc), names AS (SELECT DISTINCT set_name FROM rc),
rcf AS (SELECT runs.run_ts, names.set_name, coalesce(rc.packets,0) AS packets FROM runs CROSS JOIN names LEFT JOIN rc ON rc.run_ts=runs.run_ts AND rc.set_name=names.set_name)"""


@query(
    "list_delta",
    f"""WITH {RC}, d AS (SELECT *, coalesce(lag(packets) OVER (PARTITION BY set_name ORDER BY run_ts),0) AS prev FROM rcf)
SELECT run_ts, set_name AS list_name, CAST(CASE WHEN packets<prev THEN packets ELSE packets-prev END AS BIGINT) AS count FROM d WHERE CASE WHEN packets<prev THEN packets ELSE packets-prev END > 0""",
)
def list_delta(v):
    return deltas.list_delta(T.parse_rule_counters(v.rule_lines))


@query(
    "trap_counter",
    r"SELECT run_ts, CAST(sum(CAST(regexp_extract(line,'^\s*(\d+)',1) AS BIGINT)) AS BIGINT) AS packets FROM fw_rule_lines WHERE chain='trap' AND contains(line,'DROP') GROUP BY run_ts",
)
def trap_counter(v):
    return deltas.trap_counter(v.rule_lines, "trap")


DELTA = """d AS (SELECT *, lag(packets) OVER (PARTITION BY ip, list_type ORDER BY run_ts) AS prev FROM fw_set_snapshots),
e AS (SELECT *, CAST(CASE WHEN packets < coalesce(prev,0) THEN packets ELSE packets - coalesce(prev,0) END AS BIGINT) AS delta FROM d)"""


@query("ip_delta", f"WITH {DELTA} SELECT run_ts, ip, delta AS count, list_type FROM e WHERE delta > 0")
def ip_delta(v):
    return deltas.ip_delta(v.set_snapshots)


SENSOR_DELTA = """d AS (SELECT *, lag(packets) OVER (PARTITION BY sensor_id, ip, list_type ORDER BY run_ts) AS prev FROM fw_sensor_snapshots),
e AS (SELECT *, CAST(CASE WHEN packets < coalesce(prev,0) THEN packets ELSE packets - coalesce(prev,0) END AS BIGINT) AS delta FROM d)"""


@query("sensor_ip_delta", f"WITH {SENSOR_DELTA} SELECT run_ts, sensor_id, ip, delta AS count, list_type FROM e WHERE delta > 0")
def sensor_ip_delta(v):
    return sensors.sensor_ip_delta(v.sensor_snapshots)


@query(
    "sensor_slot_totals",
    f"""WITH {SENSOR_DELTA}, g AS (SELECT ip, list_type, run_ts // 21600 * 21600 AS slot, CAST(sum(delta) AS BIGINT) AS count, count(DISTINCT sensor_id) AS sensors FROM e GROUP BY 1,2,3),
q AS (SELECT ip, list_type, slot, slot + 21600 AS edge, sensor_id FROM g CROSS JOIN (SELECT DISTINCT sensor_id FROM fw_sensor_snapshots) t),
c AS (SELECT q.ip, q.list_type, q.slot, CAST(sum(coalesce(r.packets, 0)) AS BIGINT) AS total FROM q ASOF LEFT JOIN fw_sensor_snapshots r
  ON q.ip = r.ip AND q.list_type = r.list_type AND q.sensor_id = r.sensor_id AND q.edge > r.run_ts GROUP BY 1,2,3)
SELECT ip, list_type, slot, total, count, sensors FROM g JOIN c USING (ip, list_type, slot)""",
)
def sensor_slot_totals(v):
    """Six-hour slots; the check carries last values by an as-of join per sensor."""
    return sensors.slot_totals(v.sensor_snapshots, seconds=21600)


@query(
    "sensor_facts",
    f"""WITH {SENSOR_DELTA} SELECT (run_ts - 700 * CAST(substr(sensor_id, 2) AS INT)) // 3600 * 3600 AS timestamp, ip, CAST(sum(delta) AS BIGINT) AS count, list_type
FROM e WHERE delta > 0 GROUP BY 1, 2, 4""",
)
def sensor_facts(v):
    """Clocks put right first, then the sensors' increases summed per hour."""
    ids = v.sensor_snapshots.select("sensor_id").distinct()
    clocks = ids.withColumn("ahead", 700 * F.expr("cast(substr(sensor_id, 2) as int)"))
    return sensors.sensor_facts(sensors.on_one_clock(v.sensor_snapshots, clocks))


@query(
    "statistics_run",
    rf"""WITH {RC}, t AS (SELECT run_ts, 'AutoBan' AS set_name, CAST(sum(CAST(regexp_extract(line,'^\s*(\d+)',1) AS BIGINT)) AS BIGINT) AS packets
  FROM fw_rule_lines WHERE chain='trap' AND contains(line,'DROP') GROUP BY run_ts),
a AS (SELECT run_ts, set_name AS name, '' AS list_type, packets FROM rcf WHERE set_name <> 'AutoBan' UNION ALL SELECT run_ts, set_name, '', packets FROM t
  UNION ALL SELECT run_ts, ip, list_type, packets FROM fw_set_snapshots),
d AS (SELECT *, coalesce(lag(packets) OVER (PARTITION BY name, list_type ORDER BY run_ts),0) AS prev FROM a),
e AS (SELECT *, CAST(CASE WHEN packets<prev THEN packets ELSE packets-prev END AS BIGINT) AS count FROM d)
SELECT run_ts AS timestamp, name, list_type, count FROM e WHERE count > 0""",
)
def statistics_run(v):
    """The job over four slices of time, the third of them twice. A third of the readings of each slice's last hours come with the
    next slice, after newer ones and across restarts."""
    store = S.scratch_dir(v.spark)
    rules, snaps = T.parse_rule_counters(v.rule_lines), v.set_snapshots
    ends = F.min("run_ts"), F.max("run_ts")
    low, high = rules.select("run_ts").unionByName(snaps.select("run_ts")).agg(*ends).first()
    width = high + 1 - low
    held = (F.pmod(F.xxhash64("ip", "run_ts"), F.lit(3)) == 0) & (F.col("run_ts") < high - 86400)
    for i in (0, 1, 2, 2, 3):
        first, last = low + width * i // 4, low + width * (i + 1) // 4 - 1
        span = F.col("run_ts").between(first, last)
        late = held & (F.col("run_ts") > last - 20 * 3600)
        before = held & F.col("run_ts").between(first - 20 * 3600, first - 1)
        refresh.statistics_run(v.spark, store, rules.filter(span), snaps.filter((span & ~late) | before), None, AS_OF, v.rule_lines.filter(span))
    lists = S.read_facts(v.spark, store, "drops").select("timestamp", F.col("list_name").alias("name"), F.lit("").alias("list_type"), "count")
    rows = lists.unionByName(S.read_facts(v.spark, store, "ip_drops").select("timestamp", F.col("ip").alias("name"), "list_type", "count"))
    # Corrections are rows of their own: a reading's increase is their sum.
    sums = rows.groupBy("timestamp", "name", "list_type").agg(F.sum("count").alias("count"))
    return sums.filter(F.col("count") != 0).select("timestamp", "name", "list_type", "count")


@query("counter_delta", f"WITH {DELTA} SELECT run_ts, ip, list_type, packets, prev, delta FROM e")
def counter_delta(v):
    return deltas.counter_delta(v.set_snapshots, ["ip", "list_type"])


@query("set_sizes", "SELECT set_name, CAST(count(*) AS BIGINT) AS n, CAST(max(length(net)) AS BIGINT) AS updated_at FROM fw_net_set GROUP BY set_name")
def set_sizes(v):
    return deltas.set_sizes(v.net_set.withColumn("added_at", F.length("net").cast("long")))


def _trend(src: str, cols: str) -> str:
    return f"""SELECT {cols}run_ts, n, CASE WHEN n>p THEN concat('+',n-p) WHEN n<p THEN concat('',n-p) ELSE '=0' END AS trend
FROM (SELECT *, coalesce(lag(n) OVER (PARTITION BY set_name ORDER BY run_ts),0) AS p FROM {src}) t"""


@query("set_trend", _trend("fw_size_history", "set_name, "))
def set_trend(v):
    return deltas.set_trend(v.size_history)


@query(
    "geo_total_trend",
    "WITH g AS (SELECT 'g' AS set_name, run_ts, CAST(sum(n) AS BIGINT) AS n FROM fw_size_history WHERE set_name IN ('GeoBlock','GeoBlock6') GROUP BY run_ts) "
    + _trend("g", ""),
)
def geo_total_trend(v):
    return deltas.geo_total_trend(v.size_history)


@query(
    "vpn_trend",
    """WITH r AS (SELECT run_ts, CAST(sum(n) AS BIGINT) AS new FROM fw_size_history WHERE set_name='VPNBlock' GROUP BY run_ts)
SELECT run_ts, new, CAST(sum(new) OVER (ORDER BY run_ts) AS BIGINT) AS total, concat('+',CAST(sum(new) OVER (ORDER BY run_ts) AS BIGINT)) AS trend FROM r""",
)
def vpn_trend(v):
    return deltas.vpn_trend(v.size_history.filter(F.col("set_name") == "VPNBlock"))


@query(
    "live_total",
    f"""WITH {RC}, x AS (SELECT CASE WHEN ends_with(set_name,'6') THEN 'v6' ELSE 'v4' END AS family, sum(CASE WHEN run_ts=(SELECT max(run_ts) FROM rcf) THEN packets WHEN run_ts=(SELECT min(run_ts) FROM rcf) THEN -packets ELSE 0 END) AS n
 FROM rcf WHERE set_name IN ('FirewallBlock','AutoBan','GeoBlock','FirewallBlock6','AutoBan6','GeoBlock6') GROUP BY 1)
SELECT f.family, CAST(coalesce(n,0) AS BIGINT) AS total FROM (VALUES ('v4'),('v6')) f(family) LEFT JOIN x ON x.family=f.family""",
)
def live_total(v):
    counters = T.parse_rule_counters(v.rule_lines)
    at = lambda edge: counters.join(F.broadcast(counters.agg(edge("run_ts").alias("run_ts"))), "run_ts", "left_semi")
    return deltas.live_total(at(F.min), at(F.max))


# ---- roll-up --------------------------------------------------------------------------------------


@query(
    "rollup_drops",
    "SELECT CAST((timestamp//86400)*86400+43200 AS BIGINT) AS timestamp, list_name, CAST(sum(count) AS BIGINT) AS count FROM fw_drops WHERE timestamp < 1706659200-86400 GROUP BY timestamp//86400, list_name",
)
def rollup_drops(v):
    return retention.rollup_drops(v.drops, AS_OF)


@query(
    "rollup_ip_drops",
    "SELECT CAST((timestamp//86400)*86400+43200 AS BIGINT) AS timestamp, ip, list_type, CAST(sum(count) AS BIGINT) AS count FROM fw_ip_drops WHERE timestamp < 1706659200-86400 GROUP BY timestamp//86400, ip, list_type",
)
def rollup_ip_drops(v):
    return retention.rollup_ip_drops(v.ip_drops, AS_OF)


@query(
    "compact_drops",
    """SELECT CAST((timestamp//86400)*86400+43200 AS BIGINT) AS timestamp, list_name, CAST(sum(count) AS BIGINT) AS count FROM fw_drops WHERE timestamp < 1706659200-86400 GROUP BY timestamp//86400, list_name
UNION ALL SELECT timestamp, list_name, count FROM fw_drops WHERE timestamp >= 1706659200-86400""",
)
def compact_drops(v):
    return retention.compact(v.drops, ["list_name"], AS_OF)


# ---- period report --------------------------------------------------------------------------------


@query(
    "report_period",
    """WITH r AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'weekly' WHEN 1 THEN 'daily' WHEN 2 THEN 'monthly' ELSE 'auto' END AS mode,
 CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE 1706659200 - c_custkey*3000 END AS last_report FROM customer),
s AS (SELECT *, CASE mode WHEN 'weekly' THEN 1706659200-604800 WHEN 'daily' THEN 1706659200-86400 WHEN 'monthly' THEN 1706659200-2592000 ELSE greatest(coalesce(last_report,1706659200-86400),1706659200-2592000) END AS start FROM r)
SELECT id, mode, last_report, CAST(start AS BIGINT) AS start, CAST((1706659200-start)//3600 AS BIGINT) AS hours,
 CASE mode WHEN 'weekly' THEN 'Weekly' WHEN 'daily' THEN 'Daily' WHEN 'monthly' THEN 'Monthly' ELSE CASE WHEN (1706659200-start)//3600>=160 THEN 'Weekly' WHEN (1706659200-start)//3600>=20 THEN 'Daily' ELSE concat('Periodic (',(1706659200-start)//3600,'h)') END END AS label FROM s""",
)
def report_period(v):
    k = F.col("c_custkey")
    mode = F.when(k % 5 == 0, "weekly").when(k % 5 == 1, "daily").when(k % 5 == 2, "monthly").otherwise("auto")
    req = v.customer.select(
        k.alias("id"), mode.alias("mode"), F.when(k % 10 != 3, F.lit(AS_OF) - k * 3000).alias("last_report")
    )
    return period.report_period(req, AS_OF)


@query(
    "period_report",
    """WITH t AS (SELECT ip, CAST(sum(count) AS BIGINT) AS hits FROM fw_ip_drops WHERE timestamp > 1706659200-604800 GROUP BY ip),
p AS (SELECT target_port, CAST(sum(count) AS BIGINT) AS hits FROM fw_ip_drops d JOIN fw_ip_info i ON d.ip=i.ip WHERE timestamp > 1706659200-604800 AND target_port IS NOT NULL GROUP BY 1),
a AS (SELECT *, CAST(row_number() OVER (ORDER BY hits DESC, ip) AS INT) AS rank FROM t), b AS (SELECT *, CAST(row_number() OVER (ORDER BY hits DESC, target_port) AS INT) AS rank FROM p)
SELECT 'total' AS section, 1 AS rank, 'all' AS item, CAST(coalesce(sum(count),0) AS BIGINT) AS hits FROM fw_drops WHERE timestamp > 1706659200-604800
UNION ALL SELECT 'source', rank, ip, hits FROM a WHERE rank<=5 UNION ALL SELECT 'port', rank, CAST(target_port AS VARCHAR), hits FROM b WHERE rank<=5""",
)
def period_report(v):
    store = {"drops": v.drops, "ip_drops": v.ip_drops, "ip_info": v.ip_info}
    return period.period_report(store, period.period_start(v.spark, "weekly", AS_OF), AS_OF)


@query("period_report_text")
def period_report_text(v):
    store = {"drops": v.drops, "ip_drops": v.ip_drops, "ip_info": v.ip_info}
    return period.report_text(period.period_report(store, AS_OF - 604800, AS_OF), "Weekly")


# ---- abuse reports --------------------------------------------------------------------------------


def _recent(list_type: str, where: str, fam: int | None = None) -> str:
    f = {4: "AND contains(d.ip,'.')", 6: "AND contains(d.ip,':')", None: ""}[fam]
    return f"d.list_type='{list_type}' AND d.timestamp > 1706659200-86400 {f} AND {where}"


PORTS = "coalesce(nullif(i.port_history,''), CAST(i.target_port AS VARCHAR))"
JOIN = "fw_ip_drops d JOIN fw_ip_info i ON i.ip=regexp_replace(d.ip,'/(32|128)$','')"


def _class_sql(kind: str, fam: int | None) -> str:
    tail = {"brute": 100, "scan": 15, "unknown": 20, "static": 15, "net": 25, "geo": 20}[kind]
    end = f"GROUP BY ALL ORDER BY total DESC, ip LIMIT {tail}"
    total = "CAST(sum(d.count) AS BIGINT) AS total"
    hit = "(i.target_port IN (22,443,53,51515) OR contains(i.port_history,'/tcp') OR contains(i.port_history,'/udp'))"
    if kind == "brute":
        return f"SELECT d.ip, {total}, {PORTS} AS ports FROM {JOIN} WHERE {_recent('trap', hit, fam)} {end}"
    if kind == "scan":
        return f"SELECT d.ip, {total}, {PORTS} AS ports FROM {JOIN} WHERE {_recent('trap', 'i.target_port NOT IN (22,443,53,51515)', fam)} {end}"
    if kind == "unknown":
        left = JOIN.replace(" JOIN ", " LEFT JOIN ")
        return f"SELECT d.ip, {total}, CAST(NULL AS VARCHAR) AS ports FROM {left} WHERE {_recent('trap', 'coalesce(i.target_port,0)=0', fam)} {end}"
    host = "(NOT contains(d.ip,'/') OR regexp_matches(d.ip,'/(32|128)$'))"
    where = {"static": host, "net": f"NOT {host}", "geo": "true"}[kind]
    list_type = "geo" if kind == "geo" else "main"
    return f"SELECT d.ip, {total}, CAST(NULL AS VARCHAR) AS ports FROM fw_ip_drops d WHERE {_recent(list_type, where, fam)} {end}"


def _both(kind: str) -> str:
    return f"SELECT 4 AS family, * FROM ({_class_sql(kind, 4)}) a UNION ALL SELECT 6, * FROM ({_class_sql(kind, 6)}) b"


def _families(make):
    four, six = (make(f).select(F.lit(f).alias("family"), "ip", "total", "ports") for f in (4, 6))
    return four.unionByName(six)


SVC = (22, 443, 53, 51515)


@query("abuse_bruteforce", _both("brute"))
def abuse_bruteforce(v):
    return _families(lambda f: abuse.abuse_bruteforce(v.ip_drops, v.ip_info, SVC, AS_OF, f))


@query("abuse_scanners", _both("scan").replace("NOT IN (22,443,53,51515)", "NOT IN (22,443)"))
def abuse_scanners(v):
    return _families(lambda f: abuse.abuse_scanners(v.ip_drops, v.ip_info, (22, 443), AS_OF, f))


@query("abuse_unknown", _both("unknown"))
def abuse_unknown(v):
    return _families(lambda f: abuse.unknown_port_sources(v.ip_drops, v.ip_info, AS_OF, f))


@query("unknown_port_sources", _both("unknown").replace("LIMIT 20", ""))
def unknown_port_sources(v):
    """All of them, not only those that a report has room for."""
    return _families(lambda f: abuse.unknown_port_sources(v.ip_drops, v.ip_info, AS_OF, f, 1 << 30))


@query("abuse_static", _both("static"))
def abuse_static(v):
    return _families(lambda f: abuse.abuse_static(v.ip_drops, AS_OF, f))


@query("abuse_subnets", _class_sql("net", None))
def abuse_subnets(v):
    return abuse.abuse_subnets(v.ip_drops, AS_OF)


@query("abuse_geo", _class_sql("geo", None))
def abuse_geo(v):
    return abuse.abuse_geo(v.ip_drops, AS_OF)


PARTS = [("brute", 1, 4), ("brute", 1, 6), ("scan", 2, 4), ("scan", 2, 6), ("unknown", 3, 4), ("unknown", 3, 6), ("static", 4, 4), ("static", 4, 6), ("net", 5, None), ("geo", 6, None)]
CANDS = "c AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS class, {p} AS priority, * FROM ({_class_sql(k, f)}) q{i}" for i, (k, p, f) in enumerate(PARTS)
) + "), ch AS (SELECT *, CASE WHEN class IN ('net','geo') THEN split_part(ip,'/',1) ELSE regexp_replace(ip,'/(32|128)$','') END AS host FROM c)"
COOLED = f"""{CANDS}, cc AS (SELECT ch.*, r.last_sent, coalesce(r.last_sent>0 AND 1706659200-r.last_sent < 604800, false) AS cooling FROM ch LEFT JOIN fw_abuse_reports r ON r.ip=ch.host)"""
QUEUE = f"""{COOLED}, nh AS (SELECT k.host, CAST(sum(count) AS BIGINT) AS new_hits FROM (SELECT DISTINCT host, last_sent FROM cc WHERE last_sent>0) k
 JOIN fw_ip_drops d ON regexp_replace(d.ip,'/(32|128)$','')=k.host AND d.timestamp > k.last_sent GROUP BY k.host),
qq AS (SELECT cc.*, nh.new_hits, row_number() OVER (PARTITION BY cc.host ORDER BY priority, total DESC, cc.ip) AS rn, coalesce(last_sent>0,false) AS again FROM cc LEFT JOIN nh ON nh.host=cc.host),
st AS (SELECT *, CASE WHEN cooling THEN 'skipped_cooldown' WHEN again AND coalesce(new_hits,0)=0 THEN 'skipped_quiet' WHEN rn>1 THEN 'skipped_cooldown' ELSE 'reported' END AS status,
 coalesce(CASE WHEN length(ports)>200 THEN concat(left(ports,197),'...') ELSE ports END,'High-Risk Ports') AS pt FROM qq)"""


@query("report_cooldown", f"WITH {COOLED} SELECT class, host, total, last_sent, cooling FROM cc")
def report_cooldown(v):
    cands = abuse.all_candidates(v.ip_drops, v.ip_info, CFG, AS_OF)
    return abuse.apply_cooldown(cands, v.abuse_reports, AS_OF).select("class", "host", "total", "last_sent", "cooling")


@query("abuse_candidates", f"WITH {CANDS} SELECT class, priority, ip, total, ports, host FROM ch")
def abuse_candidates(v):
    return abuse.all_candidates(v.ip_drops, v.ip_info, CFG, AS_OF)


@query("new_hits_since_report", f"WITH {QUEUE} SELECT host, new_hits FROM nh")
def new_hits_since_report(v):
    cands = abuse.all_candidates(v.ip_drops, v.ip_info, CFG, AS_OF)
    cooled = abuse.apply_cooldown(cands, v.abuse_reports, AS_OF)
    return abuse.new_hits(cooled.filter(F.col("last_sent") > 0), v.ip_drops)


HITS24 = "total,' packets during the last day)'"
COMMENT = f"""CASE class WHEN 'brute' THEN concat('Firewall: connection attempts to closed service ports [',pt,'], trapped. (',{HITS24})
 WHEN 'scan' THEN concat('Firewall: port scan on ports [',pt,'], blocked. (',{HITS24}) WHEN 'unknown' THEN concat('Firewall: trapped traffic, port unknown (probably UDP). (',{HITS24})
 WHEN 'static' THEN concat('Firewall: repeated traffic from a listed address, blocked. (',{HITS24}) WHEN 'net' THEN concat('Firewall: listed network ',ip,' blocked, reported by its network address. (',{HITS24})
 ELSE concat('Firewall: traffic from banned region network ',ip,' blocked. (',{HITS24}) END"""


@query(
    "report_queue",
    f"""WITH {QUEUE} SELECT host AS ip, class, total, CASE class WHEN 'brute' THEN '15,14' WHEN 'net' THEN '14,4' ELSE '14' END AS categories,
 CASE WHEN status='reported' THEN concat({COMMENT}, CASE WHEN again THEN concat(' [',new_hits,' more since the report before]') ELSE '' END) END AS comment, status, ports FROM st""",
)
def report_queue(v):
    return abuse.report_queue(v.ip_drops, v.ip_info, v.abuse_reports, CFG, AS_OF)


@query("run_summary", f"WITH {QUEUE} SELECT status, CAST(count(*) AS BIGINT) AS n FROM st GROUP BY status")
def run_summary(v):
    return abuse.run_summary(abuse.report_queue(v.ip_drops, v.ip_info, v.abuse_reports, CFG, AS_OF))


@query(
    "abuse_class_limits",
    """WITH s AS (SELECT CASE list_type WHEN 'trap' THEN 'scan' WHEN 'geo' THEN 'geo' ELSE 'static' END AS class, CASE WHEN contains(ip,':') THEN 6 ELSE 4 END AS family, ip, CAST(sum(count) AS BIGINT) AS total FROM fw_ip_drops GROUP BY 1,2,3)
SELECT class, family, ip, total FROM (SELECT *, row_number() OVER (PARTITION BY class, family ORDER BY total DESC, ip) AS r FROM s) t WHERE r <= CASE class WHEN 'geo' THEN 20 ELSE 15 END""",
)
def abuse_class_limits(v):
    from dropscope.functions import ip as IP

    kind = F.when(F.col("list_type") == "trap", "scan").when(F.col("list_type") == "geo", "geo").otherwise("static")
    rows = v.ip_drops.groupBy(kind.alias("class"), IP.family("ip").alias("family"), "ip").agg(F.sum("count").alias("total"))
    return abuse.cap_class(rows)


# ---- detection ------------------------------------------------------------------------------------

BRUTE = """br AS (SELECT * FROM (SELECT pkt_id, src, proto, ts_us, CAST(count(*) OVER (PARTITION BY src, proto ORDER BY ts_us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS BIGINT) - 1 AS hits
 FROM fw_packets WHERE state='NEW' AND proto IN ('tcp','udp') AND dport IN (22,443,51515)) t WHERE hits >= 5)"""


@query("bruteforce_hits", f"WITH {BRUTE} SELECT pkt_id, src, proto, ts_us, hits FROM br")
def bruteforce_hits(v):
    return detect.bruteforce_hits(v.packets, PACKET_CFG)


# Every hit with the time of the connection `brute_hits` before it; a ban needs that one to be newer than
# the end of the ban before.
FEEDBACK = """q AS (SELECT src, ts_us, lag(ts_us, 5) OVER (PARTITION BY src, proto ORDER BY ts_us, pkt_id) AS fifth
 FROM fw_packets WHERE state='NEW' AND proto IN ('tcp','udp') AND dport IN (22,443,51515)),
offs AS (SELECT src, ts_us // 1000000 AS ts, fifth // 1000000 AS f FROM q WHERE fifth >= ts_us - 60000000),
b AS (SELECT src, min(ts) AS start_s FROM offs GROUP BY src UNION ALL SELECT b.src, min(offs.ts) FROM b JOIN offs ON offs.src=b.src AND offs.f >= b.start_s + 90 GROUP BY b.src)"""


@query(
    "bruteforce_bans",
    f"WITH RECURSIVE {FEEDBACK} SELECT src, CAST(start_s AS BIGINT) AS start_s, CAST(start_s + 90 AS BIGINT) AS end_s FROM b",
)
def bruteforce_bans(v):
    return detect.bruteforce_bans(v.packets, dataclasses.replace(PACKET_CFG, ban_timeout=90))


CONN_CFG = dataclasses.replace(PACKET_CFG, bypass_conn_tcp=(8080,), conn_limit=15, conn_limit_custom=20)
# Openings one by one: of those admitted before, the ones still open count.
LEVELS = """co AS (SELECT conn_id, src, start_us, end_us, CASE WHEN dport=8080 THEN 'custom' ELSE 'default' END AS port_class, CASE WHEN dport=8080 THEN 20 ELSE 15 END AS allowed,
  row_number() OVER (PARTITION BY src ORDER BY start_us, conn_id) AS k FROM fw_connections),
ad AS (SELECT co.*, 1::BIGINT AS open, [end_us] AS held FROM co WHERE k=1 UNION ALL
  SELECT n.*, len(l)+1, CASE WHEN len(l) < n.allowed THEN list_append(l, n.end_us) ELSE l END FROM
   (SELECT src, k+1 AS k, held FROM ad) p JOIN co n ON n.src=p.src AND n.k=p.k, LATERAL (SELECT list_filter(p.held, lambda e: e > n.start_us) AS l) x),
op AS (SELECT conn_id, src, port_class, allowed, CAST(open AS BIGINT) AS o FROM ad)"""


@query(
    "peak_connections",
    f"WITH RECURSIVE {LEVELS} SELECT src, port_class, max(o) AS peak, allowed, max(o) > allowed AS over FROM op GROUP BY src, port_class, allowed",
)
def peak_connections(v):
    return detect.peak_connections(v.connections, CONN_CFG)


@query("over_limit_opens", f"WITH RECURSIVE {LEVELS} SELECT conn_id, src, o AS open FROM op WHERE o > allowed")
def over_limit_opens(v):
    return detect.over_limit_opens(v.connections, CONN_CFG)


BANS = """b AS (SELECT src, min(ts) AS start_s FROM offs GROUP BY src UNION ALL SELECT b.src, min(offs.ts) FROM b JOIN offs ON offs.src=b.src AND offs.ts >= b.start_s + {t} GROUP BY b.src)
SELECT src, CAST(start_s AS BIGINT) AS start_s, CAST(start_s + {t} AS BIGINT) AS end_s FROM b"""


@query(
    "ban_intervals",
    "WITH RECURSIVE offs AS (SELECT DISTINCT ip AS src, timestamp AS ts FROM fw_ip_drops WHERE list_type='trap'), " + BANS.replace("{t}", "86400"),
)
def ban_intervals(v):
    trap = v.ip_drops.filter(F.col("list_type") == "trap")
    return detect.ban_intervals(trap.select(F.col("ip").alias("src"), F.col("timestamp").alias("ts")))


@query(
    "bans_from_packets",
    f"WITH RECURSIVE {CLASSIFY}, offs AS (SELECT DISTINCT src, ts_us // 1000000 AS ts FROM d WHERE reason='trap'), " + BANS.replace("{t}", "120"),
)
def bans_from_packets(v):
    out = classify.classify_packets(v.packets, v.net_set, PACKET_CFG)
    return detect.ban_intervals(classify.offences(out), timeout=120)


@query("permanent_bans", "SELECT ip AS src, CAST(min(timestamp) AS BIGINT) AS start_s, CAST(NULL AS BIGINT) AS end_s FROM fw_ip_drops WHERE list_type='trap' GROUP BY ip")
def permanent_bans(v):
    trap = v.ip_drops.filter(F.col("list_type") == "trap")
    return detect.ban_intervals(trap.select(F.col("ip").alias("src"), F.col("timestamp").alias("ts")), timeout=0)


@query(
    "classify_with_detectors",
    f"""WITH RECURSIVE {CLASSIFY}, {BRUTE}, {LEVELS}, x AS (SELECT DISTINCT conn_id FROM op WHERE o > allowed)
SELECT d.pkt_id, CASE WHEN reason='service' AND x.conn_id IS NOT NULL THEN 'connlimit' WHEN reason='service' AND br.pkt_id IS NOT NULL THEN 'bruteforce' ELSE reason END AS reason
FROM d LEFT JOIN br ON br.pkt_id=d.pkt_id LEFT JOIN x ON x.conn_id=d.pkt_id""",
)
def classify_with_detectors(v):
    brute = detect.bruteforce_hits(v.packets, PACKET_CFG)
    over = detect.over_limit_opens(v.connections, CONN_CFG)
    out = classify.classify_packets(v.packets, v.net_set, PACKET_CFG, over_limit=over, brute=brute)
    return out.select("pkt_id", "reason")


@query(
    "tail_packets",
    "SELECT pkt_id, line FROM (SELECT * FROM fw_packet_text ORDER BY pkt_id DESC LIMIT 1000) t",
)
def tail_packets(v):
    return reports.tail_packets(v.packet_text)
