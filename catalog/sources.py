"""Sources, sinks and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import AS_OF
from dropscope.config import SET_TAGS, Config
from dropscope.operators import flows, reports
from dropscope.plans.dashboard import dashboard
from dropscope.sources import store as S
from dropscope.sources import text as X

NAMES = ",".join(f"('{n}')" for n in SET_TAGS)
TAGS = ",".join(f"('{n}','{t}')" for n, t in SET_TAGS.items())
QUAD = r"([0-9]{1,3}\.){3}[0-9]{1,3}"


@query(
    "parse_rule_counters",
    rf"""WITH r AS (SELECT run_ts, chain, line_no, regexp_extract(line,'match-set (\w+)',1) AS s,
  CAST(nullif(regexp_extract(line,'^\s*(\d+)',1),'') AS BIGINT) AS p FROM fw_rule_lines),
f AS (SELECT run_ts, chain, s, arg_min(p,line_no) AS p FROM r WHERE s<>'' GROUP BY ALL),
names(set_name) AS (VALUES {NAMES})
SELECT t.run_ts, names.set_name, CAST(coalesce(sum(f.p),0) AS BIGINT) AS packets
FROM (SELECT DISTINCT run_ts FROM f) t CROSS JOIN names LEFT JOIN f ON f.run_ts=t.run_ts AND f.s=names.set_name GROUP BY ALL""",
)
def parse_rule_counters(v):
    return X.parse_rule_counters(v.rule_lines)


@query(
    "first_match",
    """SELECT run_ts, chain, s AS set_name, arg_min(p, line_no) AS packets FROM (SELECT run_ts, chain, line_no, regexp_extract(line,'match-set (\\w+)',1) AS s,
 CAST(regexp_extract(line,'^\\s*(\\d+)',1) AS BIGINT) AS p FROM fw_rule_lines) t GROUP BY ALL""",
)
def first_match(v):
    rows = v.rule_lines.select(
        "run_ts",
        "chain",
        "line_no",
        F.regexp_extract("line", r"match-set (\w+)", 1).alias("set_name"),
        F.regexp_extract("line", r"^\s*(\d+)", 1).cast("long").alias("packets"),
    )
    return X.first_match(rows, ["run_ts", "chain", "set_name"], "packets")


DUMP = rf"""WITH t(set_name,list_type) AS (VALUES {TAGS})
SELECT d.set_name, regexp_extract(line,'^(\S+) .*packets (\d+) ',1) AS ip,
 CAST(regexp_extract(line,'^(\S+) .*packets (\d+) ',2) AS BIGINT) AS packets, list_type
FROM fw_set_dump d JOIN t ON d.set_name=t.set_name WHERE regexp_matches(line,'^(\S+) .*packets (\d+) ')"""


@query("parse_set_dump", DUMP + r" AND CAST(regexp_extract(line,'packets (\d+) ',1) AS BIGINT) > 0")
def parse_set_dump(v):
    return X.parse_set_dump(v.set_dump)


@query("parse_set_dump_all_counts", DUMP)
def parse_set_dump_all(v):
    return X.parse_set_dump(v.set_dump, positive=False)


PACKETS = r"""p AS (SELECT pkt_id, CAST(CAST(w[1] AS DECIMAL(20,6))*1000000 AS BIGINT) AS ts_us,
 regexp_replace(w[list_position(w,'>')-1],':$','') AS s, regexp_replace(w[list_position(w,'>')+1],':$','') AS d,
 CASE WHEN regexp_matches(line,'Flags|seq|ack') THEN 'tcp' ELSE 'udp' END AS proto
 FROM (SELECT *, string_split_regex(trim(line),'\s+') AS w FROM fw_packet_text) t),
packets AS (SELECT * FROM (SELECT pkt_id, ts_us, CASE WHEN len(string_split(s,'.'))>=4 THEN array_to_string(string_split(s,'.')[1:4],'.') ELSE split_part(s,'.',1) END AS ip,
 CASE WHEN len(string_split(d,'.')) IN (2,5) THEN CAST(nullif(regexp_replace(string_split(d,'.')[-1],'[^0-9]','','g'),'') AS INT) ELSE 0 END AS port, proto FROM p) t
 WHERE length(ip)>=7 AND port>0)"""


@query("parse_packet_text", f"WITH {PACKETS} SELECT pkt_id, ts_us, ip, port, proto FROM packets")
def parse_packet_text(v):
    return X.parse_packets(v.packet_text)


@query("scan_log", "SELECT line FROM fw_log_lines")
def scan_log(v):
    path = S.scratch_dir(v.spark)
    v.log_lines.select("line").write.text(f"{path}/system.log")
    return X.read_logs(v.spark, f"{path}/module.log", f"{path}/system.log").select("line")


BOGON = r"^(0\.0\.0\.0|127\.|10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|169\.254\.)"
CLEAN4 = rf"""c4 AS (SELECT regexp_extract(line,'^\s*(\S+)',1) AS net FROM fw_blocklist_raw
 WHERE regexp_matches(line,'^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AND NOT regexp_matches(line,'{BOGON}'))"""
CLEAN6 = r"""c6 AS (SELECT DISTINCT regexp_extract(line,'^\s*(\S+)',1) AS net FROM fw_blocklist_raw
 WHERE regexp_matches(line,'^[0-9a-fA-F:]+') AND contains(regexp_extract(line,'^\s*(\S+)',1),':') AND NOT regexp_matches(line,'^(::1|fe80:)'))"""


@query("ingest_blocklist_v4", f"WITH {CLEAN4} SELECT net FROM c4")
def ingest_v4(v):
    return X.ingest_blocklist(v.blocklist_raw, 4)


@query("ingest_blocklist_v6", f"WITH {CLEAN6} SELECT net FROM c6")
def ingest_v6(v):
    return X.ingest_blocklist(v.blocklist_raw, 6)


@query(
    "ingest_country_zones",
    "SELECT country, split_part(line,' ',1) AS net FROM fw_zone_lines WHERE country IN ('na','fr')",
)
def ingest_zones(v):
    path = S.scratch_dir(v.spark)
    v.zone_lines.select("country", F.col("line").alias("value")).write.partitionBy("country").text(path)
    lines = v.spark.read.text(path).select("country", F.col("value").alias("line"))
    return X.ingest_zones(lines, ["NA", "fr"])


@query(
    "cached_source",
    """SELECT source, b.fetched_at AS fetched_at, b.size AS size, b.doc_id AS doc_id FROM (SELECT source, max({'fetched_at':fetched_at,'size':size,'doc_id':doc_id}) AS b
 FROM fw_downloads WHERE 1706659200 - fetched_at < 21600 AND size > 10 GROUP BY source) t""",
)
def cached_source(v):
    return X.latest_valid(v.downloads.select("source", "fetched_at", "size", "doc_id"), AS_OF)


@query(
    "load_ban_file",
    f"SELECT DISTINCT unnest(regexp_extract_all(text,'{QUAD}')) AS ip FROM documents",
)
def load_ban_file(v):
    return X.extract_ipv4(v.documents, "text")


@query(
    "parse_reputation_json",
    r"""SELECT ip, nullif(regexp_extract(json,'"countryCode":"([^"]*)"',1),'') AS country,
 CAST(nullif(regexp_extract(json,'"abuseConfidenceScore":([0-9]+)',1),'') AS INT) AS risk,
 nullif(regexp_extract(json,'"domain":"([^"]*)"',1),'') AS domain, regexp_extract(json,'"countryCode":"([^"]*)"',1) <> '' AS ok FROM fw_reputation_json""",
)
def parse_reputation(v):
    out = X.parse_reputation(v.reputation_json)
    return out.withColumn("country", F.nullif("country", F.lit("")))


@query(
    "read_fact_tables",
    """SELECT 'drops' AS name, CAST(count(*) AS BIGINT) AS n, CAST(sum(count) AS BIGINT) AS total FROM fw_drops
UNION ALL SELECT 'ip_drops', count(*), CAST(sum(count) AS BIGINT) FROM fw_ip_drops
UNION ALL SELECT 'ip_info', count(*), CAST(sum(risk) AS BIGINT) FROM fw_ip_info
UNION ALL SELECT 'abuse_reports', count(*), CAST(sum(last_sent) AS BIGINT) FROM fw_abuse_reports""",
)
def read_fact_tables(v):
    path = _stored(v)
    t = S.load_store(v.spark, path)
    value = {"drops": "count", "ip_drops": "count", "ip_info": "risk", "abuse_reports": "last_sent"}
    out = None
    for name, col in value.items():
        row = t[name].agg(F.count("*").alias("n"), F.sum(col).cast("long").alias("total"))
        row = row.select(F.lit(name).alias("name"), "n", "total")
        out = row if out is None else out.unionByName(row)
    return out


def _stored(v) -> str:
    """All four tables of the views, written as a store."""
    path = S.scratch_dir(v.spark)
    S.append_drops(v.drops, path)
    S.append_ip_drops(v.ip_drops, path)
    S.publish(v.ip_info, path, "ip_info", AS_OF)
    S.publish(v.abuse_reports, path, "abuse_reports", AS_OF)
    return path


# ---- sinks ----------------------------------------------------------------------------------------


@query("append_drops", "SELECT timestamp, list_name, count FROM fw_drops WHERE count > 0")
def append_drops(v):
    path = S.scratch_dir(v.spark)
    half = F.col("timestamp") < AS_OF - 86400
    S.append_drops(v.drops.filter(half), path)
    S.append_drops(v.drops.filter(~half), path)
    return S.read_facts(v.spark, path, "drops").drop("event_month")


@query("append_ip_drops", "SELECT timestamp, ip, count, list_type FROM fw_ip_drops WHERE count > 0")
def append_ip_drops(v):
    path = S.scratch_dir(v.spark)
    S.append_ip_drops(v.ip_drops, path)
    return S.read_facts(v.spark, path, "ip_drops").drop("event_date")


MERGED = f"""WITH {PACKETS},
l AS (SELECT ip, port, proto, max(ts_us) AS ts_us FROM packets GROUP BY ALL),
s AS (SELECT ip, list_sort(list({{'port':port,'proto':proto}})) AS seen, arg_max(port, {{'t':ts_us,'p':port}}) AS last_port FROM l GROUP BY ip),
m AS (SELECT s.ip, last_port, i.ip IS NOT NULL AS known,
  list_concat(CASE WHEN coalesce(port_history,'')='' THEN [] ELSE string_split(port_history,',') END,
   list_filter(list_transform(seen, lambda x: concat(x.port,'/',x.proto)), lambda e: NOT list_contains(string_split(coalesce(port_history,''),','), e))) AS hist
 FROM s LEFT JOIN fw_ip_info i ON i.ip=s.ip)"""


@query(
    "apply_port_history",
    MERGED
    + """ SELECT i.ip, i.country, i.risk, i.domain, CAST(CASE WHEN m.ip IS NULL THEN i.updated ELSE 1706659200 END AS BIGINT) AS updated,
 CASE WHEN m.ip IS NULL THEN i.target_port ELSE m.last_port END AS target_port,
 CASE WHEN m.ip IS NULL THEN i.port_history ELSE array_to_string(m.hist,',') END AS port_history
 FROM fw_ip_info i LEFT JOIN m ON m.ip=i.ip""",
)
def apply_port_history(v):
    return flows.apply_port_history(v.ip_info, X.parse_packets(v.packet_text), AS_OF)


@query(
    "merge_port_history",
    MERGED + " SELECT ip, last_port AS target_port, array_to_string(hist,',') AS port_history, known FROM m",
)
def merge_port_history(v):
    return flows.merge_port_history(v.ip_info, X.parse_packets(v.packet_text))


@query(
    "upsert_ip_info",
    """WITH c AS (SELECT ip, CAST(sum(count) AS BIGINT) AS n FROM fw_ip_drops WHERE list_type='trap' GROUP BY ip)
SELECT i.ip, i.country, i.risk, i.domain, i.updated, i.target_port, i.port_history FROM fw_ip_info i WHERE i.ip NOT IN (SELECT ip FROM c)
UNION ALL SELECT ip, 'ZZ', CAST(n % 100 AS INT), 'new.example', 1706659200, NULL, NULL FROM c""",
)
def upsert_ip_info(v):
    trap = v.ip_drops.filter(F.col("list_type") == "trap").groupBy("ip").agg(F.sum("count").alias("n"))
    new = trap.select(
        "ip",
        F.lit("ZZ").alias("country"),
        (F.col("n") % 100).alias("risk"),
        F.lit("new.example").alias("domain"),
        F.lit(AS_OF).alias("updated"),
    )
    return S.upsert(v.ip_info, new, ["ip"])


@query(
    "upsert_reports",
    """WITH c AS (SELECT DISTINCT ip FROM fw_ip_drops WHERE list_type='trap')
SELECT ip, last_sent FROM fw_abuse_reports WHERE ip NOT IN (SELECT ip FROM c) UNION ALL SELECT ip, 1706659200 FROM c""",
)
def upsert_reports(v):
    sent = v.ip_drops.filter(F.col("list_type") == "trap").select("ip").distinct()
    return S.upsert(v.abuse_reports, sent.withColumn("last_sent", F.lit(AS_OF)), ["ip"])


PORT_ROWS = """w(win,secs) AS (VALUES ('24h',86400),('30d',2592000),('1y',31536000),('all',NULL)),
r AS (SELECT w.win, d.ip, d.list_type, d.count, i.target_port, i.port_history,
 CASE WHEN list_contains(string_split(port_history,','), concat(target_port,'/udp')) THEN concat(target_port,'/udp')
  WHEN list_contains(string_split(port_history,','), concat(target_port,'/tcp')) THEN concat(target_port,'/tcp') ELSE cast(target_port AS VARCHAR) END AS full_port
 FROM fw_ip_drops d JOIN fw_ip_info i ON d.ip=i.ip JOIN w ON secs IS NULL OR d.timestamp > 1706659200 - secs WHERE i.target_port > 0)"""


@query(
    "write_port_ip_lists",
    f"""WITH {PORT_ROWS}, g AS (SELECT win, full_port, row_number() OVER (PARTITION BY win ORDER BY sum(count) DESC, full_port) AS rk FROM r GROUP BY win, full_port)
SELECT DISTINCT r.win AS "window", CAST(split_part(r.full_port,'/',1) AS VARCHAR) AS port, CASE WHEN contains(r.full_port,'/') THEN split_part(r.full_port,'/',2) ELSE 'any' END AS proto, ip
FROM r JOIN g ON g.win=r.win AND g.full_port=r.full_port WHERE rk<=10""",
)
def write_port_ip_lists(v):
    path = S.scratch_dir(v.spark)
    S.write_port_lists(reports.port_ip_lists(v.ip_drops, v.ip_info, AS_OF), path)
    schema = "value STRING, window STRING, port STRING, proto STRING"
    back = v.spark.read.schema(schema).text(path)
    return back.select("window", "port", "proto", F.col("value").alias("ip"))


@query("dashboard_payload")
def dashboard_payload(v):
    store = {"drops": v.drops, "ip_drops": v.ip_drops, "ip_info": v.ip_info}
    return dashboard(store, v.size_history, Config(), AS_OF)


@query("publish_set", "SELECT set_name, net FROM fw_net_set WHERE set_name='FirewallBlock'")
def publish_set(v):
    """The second publication is below its guard, so the first stays current."""
    path = S.scratch_dir(v.spark)
    S.publish_set(v.net_set, path, "FirewallBlock", AS_OF, min_rows=50)
    empty = v.net_set.filter(F.length("net") > 100)
    S.publish_set(empty, path, "FirewallBlock", AS_OF, min_rows=50)
    return S.read_versioned(v.spark, path, "set_FirewallBlock")


@query(
    "clear_disabled_set",
    "SELECT 'after' AS state, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'before', count(*) FROM fw_net_set WHERE set_name='GeoBlock'",
)
def clear_disabled_set(v):
    path = S.scratch_dir(v.spark)
    S.publish_set(v.net_set, path, "GeoBlock", AS_OF)
    S.clear_disabled_geo(v.spark, path, (), AS_OF)
    before = S.read_versioned(v.spark, path, "set_GeoBlock", version=1)
    after = S.read_versioned(v.spark, path, "set_GeoBlock")
    return before.agg(F.count("*").alias("n")).select(F.lit("before").alias("state"), "n").unionByName(
        after.agg(F.count("*").alias("n")).select(F.lit("after").alias("state"), "n")
    )


BAN = r"""ok AS (SELECT * FROM fw_ban_requests WHERE CASE WHEN regexp_matches(ip,'^(\d{1,3}\.){3}\d{1,3}$') THEN NOT regexp_matches(ip,'^(127\.|224\.|225\.|239\.|255\.255\.255\.255)') ELSE contains(ip,':') END),
e AS (SELECT event_time, concat(b, CASE WHEN contains(ip,':') THEN '6' ELSE '' END) AS set_name, ip AS net, CASE action WHEN 'ban' THEN 'add' ELSE 'remove' END AS action
 FROM ok, (VALUES ('Blacklist'),('AutoBan')) k(b) WHERE action='unban' OR b='Blacklist'),
l AS (SELECT set_name, net, arg_max(action, {'t':event_time,'a':action}) AS action FROM e GROUP BY ALL)"""


@query(
    "apply_bans",
    f"""WITH {BAN} SELECT set_name, net FROM fw_net_set n WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.set_name=n.set_name AND l.net=n.net)
UNION ALL SELECT set_name, net FROM l WHERE action='add'""",
)
def apply_bans(v):
    return S.apply_ban_events(v.net_set, S.ban_requests(v.ban_requests))


@query(
    "whitelist_edit",
    """WITH e AS (SELECT event_time, CASE WHEN contains(ip,':') THEN 'FirewallWhite6' ELSE 'FirewallWhite' END AS set_name, ip AS net, CASE action WHEN 'ban' THEN 'add' ELSE 'remove' END AS action FROM fw_ban_requests),
l AS (SELECT set_name, net, arg_max(action, {'t':event_time,'a':action}) AS action FROM e GROUP BY ALL)
SELECT set_name, net FROM fw_net_set n WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.set_name=n.set_name AND l.net=n.net)
UNION ALL SELECT set_name, net FROM l WHERE action='add'""",
)
def whitelist_edit(v):
    action = F.when(F.col("action") == "ban", "add").otherwise("remove").alias("action")
    req = v.ban_requests.select("event_time", F.col("ip").alias("net"), action)
    return S.apply_ban_events(v.net_set, S.whitelist_requests(req))


@query(
    "flush_set",
    """SELECT 'autoban' AS flushed, set_name, net FROM fw_net_set WHERE set_name NOT IN ('AutoBan','AutoBan6')
UNION ALL SELECT 'manual', set_name, net FROM fw_net_set WHERE set_name NOT IN ('Blacklist','Blacklist6')""",
)
def flush_set(v):
    one = lambda f: S.flush(v.net_set, f).select(F.lit(f).alias("flushed"), "set_name", "net")
    every = S.flush(v.net_set).select(F.lit("all").alias("flushed"), "set_name", "net")
    return one("autoban").unionByName(one("manual")).unionByName(every)


@query(
    "align_schema",
    "SELECT ip, country, risk, domain, updated, CAST(NULL AS INT) AS target_port, CAST(NULL AS VARCHAR) AS port_history FROM fw_ip_info",
)
def align_schema(v):
    old = v.ip_info.select("ip", "country", "risk", "domain", "updated")
    return S.align_schema(old, S.table_schema("ip_info"))


