"""Joins and set membership."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import hits, query, v4num
from catalog.sources import CLEAN4, CLEAN6, PACKETS
from catalog.views import AS_OF
from dropscope.config import Config
from dropscope.operators import abuse, classify, deltas, flows, membership, netsets, reports, retention
from dropscope.plans import refresh, vpn
from dropscope.sources import store as S
from dropscope.sources import text as T

QUAD = r"([0-9]{1,3}\.){3}[0-9]{1,3}"
INFO = "i.country, coalesce(i.risk,0) AS risk, i.domain, i.target_port, i.port_history, CASE WHEN coalesce(i.risk,0)>=50 THEN 'high' ELSE 'low' END AS risk_band, CASE t.list_type WHEN 'trap' THEN 'TRAP' ELSE 'MAIN' END AS badge"


@query(
    "top_ips_enriched",
    f"""WITH t AS (SELECT ip, CAST(sum(count) AS BIGINT) AS total, max(list_type) AS list_type FROM fw_ip_drops
 WHERE list_type='trap' AND timestamp > 1706659200-2592000 GROUP BY ip ORDER BY total DESC, ip LIMIT 10)
SELECT t.ip, t.total, t.list_type, {INFO} FROM t LEFT JOIN fw_ip_info i ON i.ip=split_part(t.ip,'/',1)""",
)
def top_ips_enriched(v):
    where = (F.col("list_type") == "trap") & (F.col("timestamp") > AS_OF - 2592000)
    return reports.top_ips_enriched(v.ip_drops, v.ip_info, where)


@query(
    "attach_port",
    "SELECT d.event_id, d.ip, d.count, i.target_port, i.port_history FROM fw_ip_drops d JOIN fw_ip_info i ON d.ip=i.ip",
)
def attach_port(v):
    return reports.attach_port(v.ip_drops.select("event_id", "ip", "count"), v.ip_info)


@query(
    "trap_with_ports",
    """SELECT CASE WHEN contains(d.ip,':') THEN 6 ELSE 4 END AS family, d.ip, regexp_replace(d.ip,'/(32|128)$','') AS host, CAST(sum(d.count) AS BIGINT) AS total, i.target_port, i.port_history
FROM fw_ip_drops d JOIN fw_ip_info i ON i.ip=regexp_replace(d.ip,'/(32|128)$','')
WHERE d.list_type='trap' AND d.timestamp > 1706659200-86400 GROUP BY ALL""",
)
def trap_with_ports(v):
    four, six = (abuse.trap_with_ports(v.ip_drops, v.ip_info, AS_OF, f).withColumn("family", F.lit(f)) for f in (4, 6))
    return four.unionByName(six)


HALF = 1705363200


@query(
    "snapshot_delta",
    f"""WITH s AS (SELECT ip, sum(packets) AS n FROM fw_set_snapshots WHERE run_ts < {HALF} GROUP BY ip), e AS (SELECT ip, sum(packets) AS n FROM fw_set_snapshots WHERE run_ts >= {HALF} GROUP BY ip)
SELECT e.ip, CAST(e.n - coalesce(s.n,0) AS BIGINT) AS delta FROM e LEFT JOIN s ON s.ip=e.ip WHERE e.n - coalesce(s.n,0) > 0""",
)
def snapshot_delta(v):
    """The readings of the first half of the month against those of the second."""
    early = F.col("run_ts") < HALF
    return deltas.snapshot_delta(v.set_snapshots.filter(early), v.set_snapshots.filter(~early))


@query(
    "ip_lookup",
    f"""WITH {hits('fw_packets', 'fw_net_set', 'src')}
SELECT a.ip, count(h.set_name) > 0 AS blocked, coalesce(string_agg(h.set_name, ',' ORDER BY h.set_name),'') AS lists
FROM a LEFT JOIN (SELECT * FROM h WHERE set_name NOT LIKE 'FirewallWhite%') h ON h.ip=a.ip GROUP BY a.ip""",
)
def ip_lookup(v):
    block = v.net_set.filter(~F.col("set_name").startswith("FirewallWhite"))
    out = netsets.ip_lookup(v.packets, block, "src")
    return out.select(F.col("src").alias("ip"), "blocked", F.array_join("lists", ",").alias("lists"))


@query(
    "new_attackers",
    rf"""WITH atk AS (SELECT DISTINCT unnest(regexp_extract_all(line,'{QUAD}')) AS ip FROM fw_log_lines WHERE regexp_matches(line,'TLS handshake failed|Bad encapsulated packet length')),
{hits('atk', 'fw_net_set')}
SELECT a.ip, CASE WHEN bool_or(h.set_name='FirewallBlock') THEN 'global' WHEN bool_or(h.set_name='VPNBlock') THEN 'already' ELSE 'new' END AS status
FROM a LEFT JOIN h ON h.ip=a.ip GROUP BY a.ip""",
)
def new_attackers(v):
    return netsets.new_attackers(T.attacker_ips(v.log_lines), v.net_set)


BANS = "bans AS (SELECT DISTINCT net FROM fw_net_set WHERE set_name IN ('VPNBlock','AutoBan'))"


@query(
    "redundant_bans",
    f"""WITH {BANS}, mainset AS (SELECT * FROM fw_net_set WHERE set_name='FirewallBlock'), {hits('bans', 'mainset', 'net')}
SELECT a.ip AS net, CASE WHEN h.ip IS NULL THEN 'kept' ELSE 'removed' END AS action FROM a LEFT JOIN h ON h.ip=a.ip""",
)
def redundant_bans(v):
    bans = v.net_set.filter(F.col("set_name").isin("VPNBlock", "AutoBan"))
    return netsets.redundant_bans(bans, v.net_set.filter(F.col("set_name") == "FirewallBlock"))


@query(
    "restorable_bans",
    rf"""WITH stored AS (SELECT DISTINCT unnest(regexp_extract_all(line,'{QUAD}')) AS ip FROM fw_log_lines), {hits('stored', 'fw_net_set')}
SELECT ip FROM a WHERE ip NOT IN (SELECT ip FROM h WHERE set_name IN ('FirewallBlock','VPNBlock'))""",
)
def restorable_bans(v):
    return netsets.restorable_bans(T.extract_ipv4(v.log_lines), v.net_set)


def _vpn_store(v):
    """A store with both sets, its ban file filled from the log of one VPN module."""
    store = S.scratch_dir(v.spark)
    for name in (vpn.MAIN_SET, vpn.VPN_SET):
        S.publish_set(v.net_set, store, name, AS_OF - 2 * 86400)
    vpn.import_bans(v.log_lines.filter(F.col("line").contains("openvpn")), store, AS_OF - 2 * 86400)
    return store


ATTACKERS = f"""atk AS (SELECT DISTINCT unnest(regexp_extract_all(line,'{QUAD}')) AS ip FROM fw_log_lines WHERE regexp_matches(line,'TLS handshake failed|Bad encapsulated packet length')),
stored AS (SELECT DISTINCT unnest(regexp_extract_all(line,'{QUAD}')) AS ip FROM fw_log_lines WHERE contains(line,'openvpn')),
asked AS (SELECT ip FROM atk UNION SELECT ip FROM stored)"""


@query(
    "vpn_scan",
    f"""WITH {ATTACKERS}, {hits('asked', 'fw_net_set')}
SELECT a.ip, a.ip IN (SELECT ip FROM stored) AS stored, a.ip IN (SELECT ip FROM atk) AS seen,
 CASE WHEN bool_or(h.set_name='FirewallBlock') THEN 'global' WHEN bool_or(h.set_name='VPNBlock') THEN 'already'
  WHEN a.ip IN (SELECT ip FROM stored) THEN 'restored' ELSE 'banned' END AS status
FROM a LEFT JOIN h ON h.ip=a.ip GROUP BY a.ip""",
)
def vpn_scan(v):
    store = _vpn_store(v)
    vpn.vpn_scan(v.log_lines, store, AS_OF)
    return S.read_versioned(v.spark, store, "vpn_verdicts")


@query(
    "vpn_set_after_jobs",
    f"""WITH {ATTACKERS}, own AS (SELECT net AS ip FROM fw_net_set WHERE set_name='VPNBlock'), every AS (SELECT ip FROM asked UNION SELECT ip FROM own),
{hits('every', 'fw_net_set')}, g AS (SELECT ip FROM h WHERE set_name='FirewallBlock'),
f AS (SELECT ip, ip IN (SELECT ip FROM own) AS old, ip IN (SELECT ip FROM stored) AS early, ip IN (SELECT ip FROM atk
  WHERE ip NOT IN (SELECT ip FROM stored)) AS fresh FROM every WHERE ip NOT IN (SELECT ip FROM g))
SELECT ip AS net, CAST(CASE WHEN old THEN NULL WHEN early THEN 1706659200-86400 ELSE 1706659200 END AS BIGINT) AS added_at,
 CASE WHEN early THEN 'imported' WHEN fresh AND NOT old THEN 'scan' ELSE 'set only' END AS origin FROM f""",
)
def vpn_set_after_jobs(v):
    """The VPN set after two scans, the first of one module's log, and the clean-up, each run twice."""
    store = _vpn_store(v)
    for lines, at in ((v.log_lines.filter(F.col("line").contains("openvpn")), AS_OF - 86400), (v.log_lines, AS_OF)):
        for _ in range(2):
            vpn.vpn_scan(lines, store, at)
    for _ in range(2):
        vpn.vpn_cleanup(v.spark, store, AS_OF)
    bans = S.read_versioned(v.spark, store, "vpn_bans").select(F.col("ip").alias("net"), F.when(F.col("since").isNull(), "imported").otherwise("scan").alias("origin"))
    kept = S.read_versioned(v.spark, store, "set_VPNBlock").select("net", "added_at")
    return kept.join(bans, "net", "left").select("net", "added_at", F.coalesce("origin", F.lit("set only")).alias("origin"))


VIP = """vip AS (SELECT ip FROM (SELECT ip FROM fw_ip_drops GROUP BY ip ORDER BY sum(count) DESC, ip LIMIT 15)
 UNION SELECT ip FROM (SELECT ip FROM fw_ip_drops WHERE timestamp >= 1706659200-31536000 GROUP BY ip ORDER BY sum(count) DESC, ip LIMIT 15)
 UNION SELECT ip FROM (SELECT ip FROM fw_ip_drops WHERE timestamp >= 1706659200-2592000 GROUP BY ip ORDER BY sum(count) DESC, ip LIMIT 15))"""


@query("vip_ips", f"WITH {VIP} SELECT ip FROM vip")
def vip_ips(v):
    return retention.vip_ips(v.ip_drops, AS_OF)


@query("not_vip", f"WITH {VIP} SELECT event_id, timestamp, ip, count, list_type, list_name FROM fw_ip_drops WHERE ip NOT IN (SELECT ip FROM vip)")
def not_vip(v):
    return retention.not_vip(v.ip_drops, retention.vip_ips(v.ip_drops, AS_OF))


KEPT = f"""{VIP}, kept AS (SELECT * FROM fw_ip_drops WHERE NOT (timestamp < 1706659200-2592000 AND count <= 5)
 AND NOT (timestamp < 1706659200-3888000 AND ip NOT IN (SELECT ip FROM vip)))"""


@query("retain_ip_drops", f"WITH {KEPT} SELECT event_id, timestamp, ip, count, list_type, list_name FROM kept")
def retain_ip_drops(v):
    return retention.retain_ip_drops(v.ip_drops, retention.vip_ips(v.ip_drops, AS_OF), AS_OF)


@query(
    "retention_run",
    f"""WITH {VIP}, days AS (SELECT timestamp - timestamp % 86400 + 43200 AS t, ip, list_type, CAST(sum(count) AS BIGINT) AS n
  FROM fw_ip_drops WHERE timestamp < 1706572800 GROUP BY 1,2,3)
SELECT t AS timestamp, ip AS name, list_type, n AS count FROM days WHERE NOT (t < 1706659200-2592000 AND n <= 5)
 AND NOT (t < 1706659200-3888000 AND ip NOT IN (SELECT ip FROM vip))
UNION ALL SELECT timestamp, ip, list_type, count FROM fw_ip_drops WHERE timestamp >= 1706572800
UNION ALL SELECT t, list_name, '', CAST(sum(count) AS BIGINT) FROM (SELECT *, CASE WHEN timestamp < 1706572800
  THEN timestamp - timestamp % 86400 + 43200 ELSE timestamp END AS t FROM fw_drops) x GROUP BY 1,2""",
)
def retention_run(v):
    """What the store reads after two retention runs: daily tiers before the boundary, raw rows after it."""
    store = S.scratch_dir(v.spark)
    S.append_drops(v.drops, store)
    S.append_ip_drops(v.ip_drops, store)
    S.publish(v.ip_info, store, "ip_info", AS_OF)
    for _ in range(2):
        refresh.retention_run(v.spark, store, AS_OF)
    tables = S.load_store(v.spark, store)
    lists = tables["drops"].select("timestamp", F.col("list_name").alias("name"), F.lit("").alias("list_type"), "count")
    return tables["ip_drops"].select("timestamp", F.col("ip").alias("name"), "list_type", "count").unionByName(lists)


@query(
    "stored_totals",
    f"""WITH {VIP}, w(win,secs) AS (VALUES ('24h',86400),('30d',2592000),('1y',31536000),('all',NULL)),
days AS (SELECT timestamp - timestamp % 86400 + 43200 AS t, ip, list_type, sum(count) AS n FROM fw_ip_drops WHERE timestamp < 1706572800 GROUP BY 1,2,3),
r AS (SELECT t, ip, list_type, n FROM days WHERE NOT (t < 1706659200-2592000 AND n <= 5) AND NOT (t < 1706659200-3888000 AND ip NOT IN (SELECT ip FROM vip))
  UNION ALL SELECT timestamp, ip, list_type, count FROM fw_ip_drops WHERE timestamp >= 1706572800)
SELECT ip, list_type, win AS "window", CAST(sum(n) AS BIGINT) AS total FROM r JOIN w ON secs IS NULL OR t > 1706659200-secs GROUP BY ALL""",
)
def stored_totals(v):
    """Trailing windows of a store after its retention run, from the tiles that run leaves."""
    store = S.scratch_dir(v.spark)
    S.append_ip_drops(v.ip_drops, store)
    S.append_drops(v.drops, store)
    S.publish(v.ip_info, store, "ip_info", AS_OF)
    refresh.retention_run(v.spark, store, AS_OF)
    return reports.long_totals(S.stored_totals(v.spark, store, AS_OF))


@query(
    "prune_ip_info",
    f"WITH {KEPT} SELECT ip, country, risk, domain, updated, target_port, port_history FROM fw_ip_info WHERE ip IN (SELECT split_part(ip,'/',1) FROM kept)",
)
def prune_ip_info(v):
    kept = retention.retain_ip_drops(v.ip_drops, retention.vip_ips(v.ip_drops, AS_OF), AS_OF)
    return retention.prune_ip_info(v.ip_info, kept)


@query(
    "live_top5",
    """WITH s AS (SELECT ip, sum(packets) AS n FROM fw_set_snapshots WHERE run_ts < 1705363200 GROUP BY ip),
e AS (SELECT ip, sum(packets) AS n FROM fw_set_snapshots WHERE run_ts >= 1705363200 GROUP BY ip),
d AS (SELECT e.ip, CAST(e.n - coalesce(s.n,0) AS BIGINT) AS delta FROM e LEFT JOIN s ON s.ip=e.ip WHERE e.n - coalesce(s.n,0) > 0 ORDER BY delta DESC, e.ip LIMIT 5)
SELECT d.ip, d.delta, coalesce(i.country,'--') AS country, CASE WHEN delta > 100 THEN 'red' WHEN delta > 20 THEN 'yellow' ELSE 'green' END AS severity
FROM d LEFT JOIN fw_ip_info i ON i.ip=d.ip""",
)
def live_top5(v):
    early = F.col("run_ts") < HALF
    return reports.live_top5(v.set_snapshots.filter(early), v.set_snapshots.filter(~early), v.ip_info)


CLASSIFY = f"""{hits('fw_packets', 'fw_net_set', 'src')},
o(base,rk) AS (VALUES ('FirewallBlock',0),('VPNBlock',1),('GeoBlock',2),('AutoBan',3),('Blacklist',4)),
m AS (SELECT h.ip, bool_or(h.set_name LIKE 'FirewallWhite%') AS white, arg_min(h.set_name, rk) FILTER (rk IS NOT NULL) AS matched FROM h LEFT JOIN o ON o.base=regexp_replace(h.set_name,'6$','') GROUP BY h.ip),
p AS (SELECT p.*, coalesce(m.white,false) AS white, m.matched, contains(src,':') AS v6 FROM fw_packets p LEFT JOIN m ON m.ip=p.src),
d AS (SELECT *, CASE WHEN iface LIKE 'tun%' OR (NOT v6 AND regexp_matches(src,'^(10\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|169\\.254\\.|127\\.)')) THEN 'local'
  WHEN state IN ('RELATED','ESTABLISHED') THEN 'established' WHEN white THEN 'whitelist' WHEN matched IS NOT NULL THEN 'set'
  WHEN iface='br0' OR proto='icmp' THEN 'trap_exit' WHEN sport IN (53,853) AND proto IN ('tcp','udp') THEN 'dns_reply'
  WHEN dport IN (22,443,51515) AND proto IN ('tcp','udp') THEN 'service' WHEN proto='tcp' AND dport BETWEEN 8000 AND 8050 THEN 'passive_range' ELSE 'trap' END AS reason FROM p)"""
PACKET_CFG = Config(
    tcp_services=(22, 443, 51515), udp_services=(22, 443, 51515), tcp_passive_range=(8000, 8050)
)


@query(
    "match_sets",
    f"WITH {CLASSIFY} SELECT pkt_id, src, white, matched AS matched_set FROM p",
)
def match_sets(v):
    return classify.match_sets(v.packets, v.net_set).select("pkt_id", "src", "white", "matched_set")


@query(
    "classify_packets",
    f"""WITH {CLASSIFY} SELECT pkt_id, src, dport, CASE WHEN reason IN ('set','trap') THEN 'drop' ELSE 'pass' END AS verdict, reason,
 CASE WHEN reason='set' THEN matched END AS matched_set, reason='trap' AS ban FROM d""",
)
def classify_packets(v):
    out = classify.classify_packets(v.packets, v.net_set, PACKET_CFG)
    return out.select("pkt_id", "src", "dport", "verdict", "reason", "matched_set", "ban")


@query(
    "classify_forwarded",
    f"""WITH {CLASSIFY} SELECT pkt_id, CASE WHEN reason='set' THEN 'drop' ELSE 'pass' END AS verdict,
 CASE WHEN reason IN ('local','established','whitelist','set') THEN reason ELSE 'default' END AS reason FROM d""",
)
def classify_forwarded(v):
    import dataclasses

    cfg = dataclasses.replace(PACKET_CFG, forward_protection=False)
    return classify.classify_packets(v.packets, v.net_set, cfg, forward=True).select("pkt_id", "verdict", "reason")


# ---- membership over time -------------------------------------------------------------------------

LIFE = {"AutoBan": 60, "AutoBan6": 60}
# Adds with their life and the next cut (removal, flush, rebuild); an add during a life changes nothing.
SPANS = """sm AS (SELECT * FROM fw_set_events WHERE action IN ('flush','rebuild')),
sa AS (SELECT e.set_name, e.net, e.event_time AS t, coalesce(e.timeout, (SELECT arg_max(timeout, {'t':event_time,'d':timeout}) FROM sm WHERE sm.set_name=e.set_name AND action='rebuild' AND sm.event_time<=e.event_time),
   CASE WHEN e.set_name LIKE 'AutoBan%' THEN 60 ELSE 0 END) AS d,
  least((SELECT min(event_time) FROM sm WHERE sm.set_name=e.set_name AND sm.event_time>e.event_time),
   (SELECT min(event_time) FROM fw_set_events r WHERE r.action='remove' AND r.set_name=e.set_name AND r.net=e.net AND r.event_time>=e.event_time)) AS cap FROM fw_set_events e WHERE action='add'),
so AS (SELECT set_name, net, coalesce(cap, 1::BIGINT << 61) AS cap, t, max(CASE WHEN d > 0 THEN t + d ELSE 1::BIGINT << 62 END) AS e FROM sa WHERE cap IS NULL OR cap > t GROUP BY ALL),
sb AS (SELECT set_name, net, cap, min(t) AS t, arg_min(e, t) AS e FROM so GROUP BY ALL UNION ALL
 SELECT sb.set_name, sb.net, sb.cap, min(so.t), arg_min(so.e, so.t) FROM sb JOIN so ON so.set_name=sb.set_name AND so.net=sb.net AND so.cap=sb.cap AND so.t >= sb.e GROUP BY ALL),
spans AS (SELECT set_name, net, CAST(t AS BIGINT) AS added_at, CASE WHEN least(e, cap) < 1::BIGINT << 61 THEN CAST(least(e, cap) AS BIGINT) END AS expires_at FROM sb)"""
MIDDLE = 1704067200 + 450  # half-way through the packets


@query("set_intervals", f"WITH RECURSIVE {SPANS} SELECT set_name, net, added_at, expires_at FROM spans")
def set_intervals(v):
    return membership.set_intervals(v.set_events, LIFE)


def _stored_spans(v):
    """The intervals as a stored table, which lookups read."""
    path = S.scratch_dir(v.spark)
    spans = membership.set_intervals(v.set_events, LIFE)
    spans.write.parquet(path)
    return v.spark.read.schema(spans.schema).parquet(path)


LIVE = f"live AS (SELECT * FROM spans WHERE added_at <= {MIDDLE} AND (expires_at IS NULL OR expires_at > {MIDDLE}))"


@query(
    "ip_lookup_at",
    f"""WITH RECURSIVE {SPANS}, {LIVE}, {hits('fw_packets', 'live', 'src')}
SELECT a.ip, count(h.set_name) > 0 AS blocked, coalesce(string_agg(h.set_name, ',' ORDER BY h.set_name),'') AS lists FROM a LEFT JOIN h ON h.ip=a.ip GROUP BY a.ip""",
)
def ip_lookup_at(v):
    """Which sets held each source at one second."""
    out = netsets.ip_lookup(v.packets, _stored_spans(v), "src", MIDDLE)
    return out.select(F.col("src").alias("ip"), "blocked", F.array_join("lists", ",").alias("lists"))


@query(
    "match_sets_at",
    f"""WITH RECURSIVE {SPANS}, k AS (SELECT DISTINCT src, ts_us // 1000000 AS s FROM fw_packets),
{hits('k', "(SELECT concat(set_name,'|',added_at,'|',coalesce(CAST(expires_at AS VARCHAR),'')) AS set_name, net FROM spans)", 'src')},
o(base,rk) AS (VALUES ('FirewallBlock',0),('VPNBlock',1),('GeoBlock',2),('AutoBan',3),('Blacklist',4)),
x AS (SELECT k.src, k.s, split_part(set_name,'|',1) AS set_name FROM k JOIN h ON h.ip=k.src WHERE CAST(split_part(set_name,'|',2) AS BIGINT) <= s AND (split_part(set_name,'|',3) = '' OR TRY_CAST(split_part(set_name,'|',3) AS BIGINT) > s)),
m AS (SELECT src, s, bool_or(set_name LIKE 'FirewallWhite%') AS white, arg_min(set_name, rk) FILTER (rk IS NOT NULL) AS matched FROM x LEFT JOIN o ON o.base=regexp_replace(set_name,'6$','') GROUP BY 1,2)
SELECT pkt_id, p.src, coalesce(white,false) AS white, matched AS matched_set FROM fw_packets p LEFT JOIN m ON m.src=p.src AND m.s=p.ts_us // 1000000""",
)
def match_sets_at(v):
    """Sets that held a packet's source in the packet's own second."""
    return classify.match_sets(v.packets, _stored_spans(v), ts="ts_us").select("pkt_id", "src", "white", "matched_set")


@query(
    "apply_bans_at",
    f"WITH RECURSIVE {SPANS.replace('FROM fw_set_events', 'FROM ev').replace('sm AS (', 'ev AS (SELECT event_time, set_name, net, action, timeout FROM fw_set_events WHERE event_time <= ' + str(MIDDLE) + ' UNION ALL SELECT 0, set_name, net, ' + chr(39) + 'add' + chr(39) + ', 0 FROM fw_net_set), sm AS (', 1)}, {LIVE} SELECT set_name, net, added_at, expires_at FROM live",
)
def apply_bans_at(v):
    """The stored sets after all events up to one second, with the times of their entries."""
    stored = v.net_set.withColumns({c: F.lit(None).cast("bigint") for c in ("added_at", "expires_at")})
    return S.apply_ban_events(stored, v.set_events, MIDDLE, LIFE)


# ---- port credit by time --------------------------------------------------------------------------

# The packets stretched over the time of the facts.
STRETCH = f"{AS_OF}000000 - ({AS_OF}000000 - 1704067200000000 - (ts_us - 1704067200000000) * 2880) * 14"


def _credit(select: str) -> str:
    return f"""WITH w AS (SELECT src AS host, {STRETCH} AS us, max(concat(dport,'/',proto)) AS full_port FROM fw_packets WHERE dport IS NOT NULL GROUP BY 1,2),
d AS (SELECT *, regexp_replace(ip,'/(32|128)$','') AS host, timestamp*1000000 + 999999 AS us FROM fw_ip_drops),
j AS (SELECT d.event_id, d.ip, d.count, w.full_port FROM d ASOF LEFT JOIN w ON d.host=w.host AND d.us >= w.us) {select}"""


def _port_packets(v):
    return v.packets.select(F.expr(STRETCH.replace(str(AS_OF) + "000000", str(AS_OF) + "000000L")).alias("ts_us"), F.col("src").alias("ip"), F.col("dport").alias("port"), "proto")


@query("port_at_hit", _credit("SELECT event_id, ip, count, full_port FROM j"))
def port_at_hit(v):
    return flows.port_at_hit(v.ip_drops, _port_packets(v)).select("event_id", "ip", "count", "full_port")


@query("port_credit", _credit("SELECT full_port, count(DISTINCT ip) AS ips, CAST(sum(count) AS BIGINT) AS total FROM j GROUP BY full_port"))
def port_credit(v):
    return flows.port_credit(v.ip_drops, _port_packets(v))


# ---- set operations and merging -------------------------------------------------------------------


@query(
    "all_set_hits",
    "SELECT ip, list_type, count FROM fw_ip_drops",
)
def all_set_hits(v):
    one = lambda t: v.ip_drops.filter(F.col("list_type") == t).select("ip", "list_type", "count")
    return T.all_set_hits([one("trap"), one("geo"), one("manual"), one("main")])


@query("union_sources", "SELECT line FROM fw_blocklist_raw UNION ALL SELECT line FROM fw_zone_lines")
def union_sources(v):
    from dropscope.sources.store import scratch_dir

    path = scratch_dir(v.spark)
    v.blocklist_raw.select("line").write.text(f"{path}/a")
    v.zone_lines.select("line").write.text(f"{path}/b")
    return T.read_lines(v.spark, [f"{path}/a", f"{path}/b"]).select("line")


@query("distinct_flows", f"WITH {PACKETS} SELECT DISTINCT ip, port, proto FROM packets")
def distinct_flows(v):
    return flows.distinct_flows(T.parse_packets(v.packet_text))


@query("distinct_nets", f"WITH {CLEAN4}, {CLEAN6} SELECT net FROM c4 UNION SELECT net FROM c6")
def distinct_nets(v):
    both = T.ingest_blocklist(v.blocklist_raw, 4).unionByName(T.ingest_blocklist(v.blocklist_raw, 6))
    return netsets.distinct_nets(both)


@query(
    "set_changes",
    f"""WITH {CLEAN4}, {CLEAN6}, o AS (SELECT net FROM c4 UNION SELECT net FROM c6), n AS (SELECT DISTINCT net FROM fw_net_set)
SELECT coalesce(o.net,n.net) AS net, CASE WHEN o.net IS NULL THEN 'added' ELSE 'removed' END AS change FROM o FULL JOIN n ON o.net=n.net WHERE o.net IS NULL OR n.net IS NULL""",
)
def set_changes(v):
    """The cleaned lists as the old version, the loaded sets as the new one."""
    old = T.ingest_blocklist(v.blocklist_raw, 4).unionByName(T.ingest_blocklist(v.blocklist_raw, 6))
    return netsets.set_changes(old, v.net_set)


RANGES = f"""{CLEAN4}, z AS (SELECT net FROM c4 UNION SELECT net FROM fw_net_set WHERE NOT contains(net,':') UNION SELECT concat('203.',k,'.0.0/16') FROM (SELECT DISTINCT p_size AS k FROM part) t
  UNION SELECT concat('64.0.0.0/',3 + p_size % 9) FROM part),
q AS (SELECT {v4num('net')} AS b, CASE WHEN contains(net,'/') THEN CAST(split_part(net,'/',2) AS INT) ELSE 32 END AS p FROM z),
r AS (SELECT b - b % (1::BIGINT << (32-p)) AS lo, b - b % (1::BIGINT << (32-p)) + (1::BIGINT << (32-p)) - 1 AS hi FROM q),
s AS (SELECT lo, hi, CASE WHEN lo <= max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS f FROM r),
i AS (SELECT lo, hi, sum(f) OVER (ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM s),
islands AS (SELECT min(lo) AS lo, max(hi) AS hi FROM i GROUP BY g)"""


def _merge_input(v):
    wide = v.part.select(F.concat(F.lit("203."), F.col("p_size").cast("string"), F.lit(".0.0/16")).alias("net"))
    huge = v.part.select(F.concat(F.lit("64.0.0.0/"), (3 + F.col("p_size") % 9).cast("string")).alias("net"))
    return T.ingest_blocklist(v.blocklist_raw, 4).unionByName(v.net_set.select("net")).unionByName(wide).unionByName(huge)


@query("merge_cidrs", f"WITH {RANGES} SELECT lo, hi FROM islands")
def merge_cidrs(v):
    return netsets.merge_cidrs(_merge_input(v))


@query(
    "minimal_cidrs",
    f"""WITH RECURSIVE {RANGES},
b AS (SELECT lo AS nxt, hi, lo AS s, CAST(0 AS BIGINT) AS n FROM islands
 UNION ALL SELECT nxt + sz, hi, nxt, sz FROM (SELECT *, CAST(least(CASE WHEN nxt=0 THEN 4294967296 ELSE nxt & (-nxt) END, CAST(pow(2, floor(log2(hi-nxt+1))) AS BIGINT)) AS BIGINT) AS sz FROM b WHERE nxt <= hi) t)
SELECT concat(s>>24,'.',(s>>16)&255,'.',(s>>8)&255,'.',s&255,'/',32 - CAST(log2(n) AS INT)) AS net, s AS lo, s+n-1 AS hi FROM b WHERE n > 0""",
)
def minimal_cidrs(v):
    return netsets.minimal_cidrs(netsets.merge_cidrs(_merge_input(v)))


@query("blocklist_v6_clean", f"WITH {CLEAN6} SELECT 'FirewallBlock6' AS set_name, net FROM c6")
def blocklist_v6_clean(v):
    return refresh.clean_v6(v.blocklist_raw)
