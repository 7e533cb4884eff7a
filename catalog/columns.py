"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import plen, query, v4num, v6hex
from catalog.sources import BOGON
from catalog.views import AS_OF
from dropscope.config import Config
from dropscope.functions import ip as IP
from dropscope.functions import ports as P
from dropscope.functions import text as X
from dropscope.operators import deltas, enrich, netsets, reports
from dropscope.sources import text as T

CFG = Config()


@query(
    "family_filter",
    """SELECT event_id, ip, 6 AS family FROM fw_ip_drops WHERE contains(ip,':')
UNION ALL SELECT event_id, ip, 4 FROM fw_ip_drops WHERE contains(ip,'.')""",
)
def family_filter(v):
    one = lambda f: deltas.family_filter(v.ip_drops, f).select("event_id", "ip", F.lit(f).alias("family"))
    return one(6).unionByName(one(4))


@query(
    "host_vs_net_filter",
    r"""SELECT DISTINCT ip, contains(ip,'/') AS is_net, NOT contains(ip,'/') OR regexp_matches(ip,'/(32|128)$') AS is_host
FROM (SELECT ip FROM fw_ip_drops UNION ALL SELECT net FROM fw_net_set) t""",
)
def host_vs_net(v):
    both = v.ip_drops.select("ip").unionByName(v.net_set.select(F.col("net").alias("ip"))).distinct()
    return both.select("ip", IP.is_net("ip").alias("is_net"), IP.is_host_text("ip").alias("is_host"))


@query(
    "strip_prefix",
    r"SELECT net, split_part(net,'/',1) AS bare, regexp_replace(net,'/(32|128)$','') AS host FROM fw_net_set",
)
def strip_prefix(v):
    return v.net_set.select(
        "net", IP.strip_prefix("net").alias("bare"), IP.strip_prefix("net", only_host=True).alias("host")
    )


@query(
    "address_arithmetic",
    f"""SELECT DISTINCT net, CASE WHEN contains(net,':') THEN {v6hex('net')} ELSE lpad(printf('%x',{v4num('net')}),8,'0') END AS bits,
 CAST({plen('net')} AS INT) AS plen FROM fw_net_set""",
)
def address_arithmetic(v):
    return netsets.with_bits(v.net_set.select("net").distinct(), "net").select("net", "bits", "plen")


@query(
    "time_window",
    """SELECT w.n AS "window", CAST(count(*) AS BIGINT) AS rows_in, CAST(sum(count) AS BIGINT) AS total
FROM fw_ip_drops d JOIN (VALUES ('24h',86400),('30d',2592000),('1y',31536000),('all',NULL)) w(n,s)
 ON w.s IS NULL OR d.timestamp > 1706659200 - w.s GROUP BY w.n""",
)
def time_window(v):
    """All four windows from one scan."""
    from dropscope.config import WINDOWS

    def flag(s):
        return F.lit(True) if s is None else F.col("timestamp") > AS_OF - s

    names = F.array_compact(F.array(*[F.when(flag(s), F.lit(w)) for w, s in WINDOWS.items()]))
    rows = v.ip_drops.select(F.explode(names).alias("window"), "count")
    return rows.groupBy("window").agg(F.count("*").alias("rows_in"), F.sum("count").alias("total"))


@query(
    "honeypot_port_filter",
    """SELECT 'both' AS ports, ip, target_port FROM fw_ip_info WHERE (target_port IN (22,443) AND list_contains(string_split(port_history,','), concat(target_port,'/tcp')))
 OR (target_port IN (53,51515) AND list_contains(string_split(port_history,','), concat(target_port,'/udp')))""",
)
def honeypot(v):
    cols = ["ip", "target_port"]
    both = reports.honeypot_filter(v.ip_info, CFG.tcp_services, CFG.udp_services).select(F.lit("both").alias("ports"), *cols)
    none = reports.honeypot_filter(v.ip_info, (), ()).select(F.lit("none").alias("ports"), *cols)
    return both.unionByName(none)


@query(
    "bogon_filter_v4",
    rf"SELECT line_no, line FROM fw_blocklist_raw WHERE contains(line,'.') AND NOT regexp_matches(line,'{BOGON}')",
)
def bogon_v4(v):
    return T.drop_bogons_v4(v.blocklist_raw.filter(F.col("line").contains(".")), "line")


@query(
    "bogon_filter_v6",
    "SELECT line_no, line FROM fw_blocklist_raw WHERE contains(line,':') AND NOT regexp_matches(line,'^(::1|fe80:)')",
)
def bogon_v6(v):
    return T.drop_bogons_v6(v.blocklist_raw.filter(F.col("line").contains(":")), "line")


@query(
    "lan_classifier",
    rf"""SELECT net, CASE WHEN contains(net,':') THEN false ELSE
  {v4num('net')} BETWEEN 167772160 AND 184549375 OR {v4num('net')} BETWEEN 2886729728 AND 2887778303 OR {v4num('net')} BETWEEN 3232235520 AND 3232301055
  OR {v4num('net')} < 16777216 OR {v4num('net')} BETWEEN 2130706432 AND 2147483647 OR {v4num('net')} BETWEEN 3758096384 AND 3774873599 OR {v4num('net')} >= 4278190080 END AS lan
FROM (SELECT DISTINCT src AS net FROM fw_packets UNION SELECT regexp_extract(line,'^\S+') FROM fw_blocklist_raw WHERE regexp_matches(line,'^[0-9]+\.')) t""",
)
def lan_classifier(v):
    nets = v.packets.select(F.col("src").alias("net")).unionByName(
        v.blocklist_raw.filter(F.col("line").rlike(r"^[0-9]+\.")).select(T.first_word("line").alias("net"))
    )
    return nets.distinct().select("net", IP.is_private("net").alias("lan"))


@query(
    "enrichment_status",
    r"""WITH j AS (SELECT ip, regexp_extract(json,'"countryCode":"([^"]*)"',1) AS c, CAST(nullif(regexp_extract(json,'"abuseConfidenceScore":([0-9]+)',1),'') AS INT) AS r, regexp_extract(json,'"domain":"([^"]*)"',1) AS d FROM fw_reputation_json),
t AS (SELECT split_part(ip,'/',1) AS ip, sum(count) AS total FROM (SELECT ip, count FROM fw_ip_drops UNION ALL SELECT src, 1 FROM fw_packets) u GROUP BY 1),
s AS (SELECT t.*, j.*, CASE WHEN regexp_matches(t.ip,'^(10\.|127\.|192\.168\.)') THEN 'lan' WHEN total < 5 THEN 'skipped' WHEN c<>'' THEN 'known' ELSE 'unknown' END AS status FROM t LEFT JOIN j ON j.ip=t.ip)
SELECT s.ip, CASE status WHEN 'lan' THEN 'LAN' WHEN 'skipped' THEN '--' WHEN 'known' THEN c ELSE 'XX' END AS country,
 CASE status WHEN 'known' THEN coalesce(r,0) ELSE 0 END AS risk,
 CASE status WHEN 'lan' THEN 'private address' WHEN 'skipped' THEN 'too few hits to ask' WHEN 'known' THEN d ELSE 'no answer' END AS domain, status FROM s""",
)
def enrichment_status(v):
    hits = v.ip_drops.select("ip", "count").unionByName(
        v.packets.select(F.col("src").alias("ip"), F.lit(1).cast("long").alias("count"))
    )
    per = hits.groupBy(IP.strip_prefix("ip").alias("ip")).agg(F.sum("count").alias("total"))
    return enrich.enrich(per, T.parse_reputation(v.reputation_json))


@query("risk_band", "SELECT ip, risk, CASE WHEN risk >= 50 THEN 'high' ELSE 'low' END AS band FROM fw_ip_info")
def risk_band(v):
    return v.ip_info.select("ip", "risk", X.risk_band("risk").alias("band"))


@query(
    "severity_band",
    "SELECT event_id, count, CASE WHEN count > 100 THEN 'red' WHEN count > 20 THEN 'yellow' ELSE 'green' END AS band FROM fw_ip_drops",
)
def severity_band(v):
    return v.ip_drops.select("event_id", "count", X.severity_band("count").alias("band"))


@query(
    "port_label",
    """SELECT ip, CASE WHEN list_contains(string_split(port_history,','), concat(target_port,'/udp')) THEN concat(target_port,'/udp')
 WHEN list_contains(string_split(port_history,','), concat(target_port,'/tcp')) THEN concat(target_port,'/tcp') ELSE CAST(target_port AS VARCHAR) END AS label FROM fw_ip_info""",
)
def port_label(v):
    return v.ip_info.select("ip", P.port_label("target_port", "port_history").alias("label"))


@query("list_badge", "SELECT event_id, CASE list_type WHEN 'trap' THEN 'TRAP' ELSE 'MAIN' END AS badge FROM fw_ip_drops")
def list_badge(v):
    return v.ip_drops.select("event_id", X.list_badge("list_type").alias("badge"))


@query(
    "validate_ip",
    r"""SELECT ip, CASE WHEN regexp_matches(ip,'^(\d{1,3}\.){3}\d{1,3}$') THEN NOT regexp_matches(ip,'^(127\.|224\.|225\.|239\.|255\.255\.255\.255)') ELSE contains(ip,':') END AS valid
FROM (SELECT ip FROM fw_ban_requests UNION SELECT line FROM fw_blocklist_raw) t""",
)
def validate_ip(v):
    texts = v.ban_requests.select("ip").unionByName(v.blocklist_raw.select(F.col("line").alias("ip"))).distinct()
    return texts.select("ip", IP.validate_ip("ip").alias("valid"))


@query(
    "log_pattern_filter",
    "SELECT line_no, line FROM fw_log_lines WHERE contains(line,'TLS handshake failed') OR contains(line,'Bad encapsulated packet length')",
)
def log_pattern(v):
    return T.match_attack_lines(v.log_lines)


@query("country_filter", "SELECT line_no, country, line FROM fw_zone_lines WHERE country = 'na'")
def country_filter(v):
    return T.country_filter(v.zone_lines, ["NA", "xx"])


@query(
    "set_health",
    """SELECT set_name, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(*) > CASE WHEN ends_with(set_name,'6') THEN 10 ELSE 100 END THEN 'OK' ELSE 'CRITICAL' END AS status
FROM fw_net_set WHERE set_name IN ('FirewallBlock','FirewallBlock6') GROUP BY set_name""",
)
def set_health(v):
    main = v.net_set.filter(F.col("set_name").isin("FirewallBlock", "FirewallBlock6"))
    return deltas.set_health(deltas.set_sizes(main))


@query(
    "ports_preview",
    """WITH m AS (SELECT ip, list_sort(list(DISTINCT port)) AS p FROM (SELECT src AS ip, sport AS port FROM fw_packets WHERE sport>0) t GROUP BY ip)
SELECT ip, array_to_string(p[1:3],', ') AS shown, CAST(greatest(len(p)-3,0) AS INT) AS more,
 array_to_string(p[4:],', ') AS hidden FROM m""",
)
def ports_preview(v):
    # A source has at most 65,535 distinct ports.
    ports = v.packets.filter(F.col("sport") > 0).groupBy(F.col("src").alias("ip")).agg(
        F.array_sort(F.collect_set("sport")).alias("p")
    )
    out = ports.select("ip", P.preview(F.transform("p", lambda x: x.cast("string"))).alias("v"))
    return out.select("ip", "v.shown", "v.more", "v.hidden")


@query(
    "toggle_ports",
    """SELECT ip, array_to_string(list_sort(CASE WHEN list_contains(p, coalesce(target_port,0)) THEN list_filter(p, lambda x: x<>coalesce(target_port,0)) ELSE list_append(p, coalesce(target_port,0)) END),' ') AS ports
FROM (SELECT ip, target_port, [22,443,53] AS p FROM fw_ip_info) t""",
)
def toggle_ports(v):
    now = F.array(F.lit(22), F.lit(443), F.lit(53))
    out = P.toggle_ports(now, F.coalesce("target_port", F.lit(0)))
    return v.ip_info.select("ip", F.array_join(F.array_sort(out), " ").alias("ports"))


@query(
    "duration_seconds",
    """SELECT event_id, CAST((event_id % 3)*2592000 + (event_id % 5)*604800 + (event_id % 7)*86400 + (event_id % 24)*3600 + (event_id % 60)*60 + event_id % 59 AS BIGINT) AS seconds,
 concat(event_id // 86400,'d ',(event_id % 86400)//3600,'h') AS uptime FROM events""",
)
def duration_seconds(v):
    e = F.col("event_id")
    return v.events.select(
        "event_id",
        X.duration_seconds(e % 3, e % 5, e % 7, e % 24, e % 60, e % 59).alias("seconds"),
        X.uptime_text(e).alias("uptime"),
    )


@query(
    "config_counts",
    "SELECT source, CAST(len(list_filter(string_split_regex(text,'\\s+'), lambda w: w<>'')) AS BIGINT) AS n FROM (SELECT source, string_agg(DISTINCT lang,' ') AS text FROM documents GROUP BY source) t",
)
def config_counts(v):
    """Number of entries in a space-separated list."""
    lists = v.documents.groupBy("source").agg(F.array_join(F.collect_set("lang"), " ").alias("text"))
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return lists.select("source", F.size(words).cast("long").alias("n"))


@query(
    "active_history",
    "SELECT DISTINCT p.src AS ip, coalesce(i.port_history,'') AS port_history FROM fw_packets p LEFT JOIN fw_ip_info i ON i.ip=p.src",
)
def active_history(v):
    from dropscope.operators.flows import active_history as op

    return op(v.packets.select(F.col("src").alias("ip")), v.ip_info)
