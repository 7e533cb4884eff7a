"""Fixed-text parser cases and regressions for known misreadings."""

import pytest
from pyspark.sql import functions as F

from dropscope.functions import ip as IP
from dropscope.functions import ports as P
from dropscope.functions import text as X
from dropscope.sources import text as T


def one(df):
    return [tuple(r) for r in df.collect()]


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "line string")


PACKETS = [
    ("1704067207.179575 IP 198.51.0.8.5353 > 203.0.113.1.22: Flags [S], seq 1", ("198.51.0.8", 22, "tcp")),
    ("1704067207.1 eth3 In IP 198.51.0.8.53 > 203.0.113.1.443: UDP, length 20", ("198.51.0.8", 443, "udp")),
    ("1704067207.1 IP6 2001:db8::5.1024 > 2001:db8:ffff::1.22: Flags [S]", ("2001:db8::5", 22, "tcp")),
    # IPv6 without a port: the last group must not be read as one.
    ("1704067207.1 IP6 2001:db8::5 > 2001:db8:ffff::1: ICMP6, echo", None),
    ("1704067207.1 IP 198.51.0.8 > 203.0.113.1: ICMP echo request", None),
    # A source shorter than seven characters is noise.
    ("1704067207.1 IP ::5.1024 > 2001:db8:ffff::1.22: Flags [S]", ("::5", 22, "tcp")),
    ("no arrow here", None),
    ("1704067207.1 IP 198.51.0.8.1 > ", None),
]


@pytest.mark.parametrize("text,want", PACKETS)
def test_packet_line(spark, text, want):
    got = one(T.parse_packets(lines(spark, text)).select("ip", "port", "proto"))
    assert got == ([] if want is None else [want])


def test_packets_since_keeps_microseconds(spark):
    text = "1704067207.{} IP 198.51.0.8.1 > 203.0.113.1.22: Flags"
    df = lines(spark, text.format("000001"), text.format("000002"), text.format("000003"))
    got = T.parse_packets(df, since_us=1704067207000001).select("ts_us")
    assert sorted(one(got)) == [(1704067207000002,), (1704067207000003,)]


def test_blocklist_lines(spark):
    df = lines(
        spark, "# 1.2.3.4", "", "1.2.3.4 ; x", "  5.6.7.8", "10.0.0.1", "172.31.0.0/16", "172.32.0.0/16", "abc",
        "2001:DB8::/32 y", "fe80::1", "::1", "face", "::2",
    )
    assert sorted(one(T.ingest_blocklist(df, 4))) == [("1.2.3.4",), ("172.32.0.0/16",)]
    assert sorted(one(T.ingest_blocklist(df, 6))) == [("2001:DB8::/32",), ("::2",)]


def test_rule_counters_take_first_rule_and_whole_names(spark):
    rows = [
        (1, "input", 1, " 5 300 NFLOG all match-set FirewallBlock src"),
        (1, "input", 2, " 9 300 DROP all match-set FirewallBlock src"),
        (1, "input", 3, " 70 300 DROP all match-set FirewallBlock6 src"),
        (1, "forward", 1, " 2 300 DROP all match-set FirewallBlock src"),
    ]
    df = spark.createDataFrame(rows, "run_ts int, chain string, line_no int, line string")
    got = {r.set_name: r.packets for r in T.parse_rule_counters(df).collect()}
    assert got["FirewallBlock"] == 7 and got["FirewallBlock6"] == 70 and got["AutoBan"] == 0


def test_reputation_failure(spark):
    rows = [("a", '{"data":{"countryCode":"NL","abuseConfidenceScore":9,"domain":"x"}}'), ("b", ""), ("c", "{bad")]
    df = spark.createDataFrame(rows, "ip string, json string")
    got = {r.ip: (r.country, r.risk, r.ok) for r in T.parse_reputation(df).collect()}
    assert got == {"a": ("NL", 9, True), "b": (None, None, False), "c": (None, None, False)}


def test_logs_prefer_the_module_log(spark, tmp_path):
    (tmp_path / "sys").write_text("s\n")
    assert one(T.read_logs(spark, f"{tmp_path}/mod", f"{tmp_path}/sys").select("line")) == [("s",)]
    (tmp_path / "mod").write_text("m\n")
    assert one(T.read_logs(spark, f"{tmp_path}/mod", f"{tmp_path}/sys").select("line")) == [("m",)]


def test_zone_country_from_file_name(spark):
    df = spark.createDataFrame([("s3://x/zones/NL-aggregated.zone",)], "source string")
    assert one(df.select(T.zone_country("source"))) == [("nl",)]


def test_port_entries_match_whole(spark):
    """80 is not found inside 8080, on either protocol."""
    df = spark.createDataFrame([(80, "8080/tcp,8080/udp"), (80, "8080/udp,80/tcp"), (80, None)], "p int, h string")
    assert one(df.select(P.port_label("p", "h"))) == [("80",), ("80/tcp",), ("80",)]


def test_history_round_trip(spark):
    df = spark.createDataFrame([("443/tcp,22/tcp",), ("",), (None,)], "h string")
    assert one(df.select(P.render_history(P.parse_history("h")))) == [("443/tcp,22/tcp",), ("",), ("",)]


def test_private_ranges_end_where_they_should(spark):
    df = spark.createDataFrame(
        [(x,) for x in ("172.16.0.1", "172.31.9.9", "172.160.0.1", "172.32.0.1", "172.200.1.1", "192.168.0.1", "192.169.0.1", "::1", "fe80::1", "feb0::1", "fec0::1", "2001::1", "127.0.0.1")],
        "ip string",
    )
    got = {r[0] for r in df.filter(IP.is_private("ip")).collect()}
    assert got == {"172.16.0.1", "172.31.9.9", "192.168.0.1", "::1", "fe80::1", "feb0::1", "127.0.0.1"}


def test_validate_ip_is_a_shape_check(spark):
    df = spark.createDataFrame([(x,) for x in ("999.1.1.1", "127.0.0.1", "224.0.0.1", "239.1.1.1", "::1", "x")], "ip string")
    assert [r[0] for r in df.select(IP.validate_ip("ip")).collect()] == [True, False, False, False, True, False]


def test_small_texts(spark):
    row = spark.range(1).select(
        X.signed(F.lit(3)), X.signed(F.lit(-3)), X.signed(F.lit(0)), X.signed(F.lit(0), "+0"),
        X.duration_seconds(months=1, weeks=1, days=1, hours=1, minutes=1, seconds=1),
        F.length(X.shorten(F.lit("x" * 250))), F.length(X.shorten(F.lit("x" * 200))), X.uptime_text(F.lit(90061)),
    ).first()
    assert list(row) == ["+3", "-3", "=0", "+0", 2592000 + 604800 + 86400 + 3600 + 61, 200, 200, "1d 1h"]


def test_preview_cuts_hidden_text(spark):
    df = spark.createDataFrame([([str(i) for i in range(150)],), (["1"],)], "a array<string>")
    assert df.select(P.preview("a")).first()[0].hidden == ", ".join(map(str, range(3, 150)))
    rows = [r[0] for r in df.select(P.preview("a", hidden_max=100)).collect()]
    assert rows[0].shown == "0, 1, 2" and rows[0].more == 147 and rows[0].hidden.endswith("102, ...")
    assert rows[1].more == 0 and rows[1].hidden == ""
