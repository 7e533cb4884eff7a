"""Rule order on single packets."""

import dataclasses

import pytest

from dropscope.config import Config
from dropscope.operators.classify import classify_packets

CFG = Config(tcp_services=(22,), udp_services=(53,), tcp_passive_range=(5000, 5010))
SETS = [
    ("FirewallBlock", "9.9.0.0/16"), ("VPNBlock", "9.9.1.1"), ("AutoBan", "8.8.8.8"), ("Blacklist", "7.7.7.7"),
    ("FirewallWhite", "9.9.9.9"), ("FirewallBlock6", "2001:db8::/32"), ("FirewallWhite6", "2001:db8::7"),
]
# src, dst, iface, proto, sport, dport, state → reason
CASES = [
    (("127.0.0.1", "1.1.1.1", "eth3", "tcp", 9, 9, "NEW"), "local"),
    (("9.9.2.2", "1.1.1.1", "tun0", "tcp", 9, 9, "NEW"), "local"),
    (("172.20.0.1", "1.1.1.1", "eth3", "tcp", 9, 9, "NEW"), "local"),
    (("172.32.0.1", "1.1.1.1", "eth3", "tcp", 9, 9, "NEW"), "trap"),
    (("9.9.2.2", "1.1.1.1", "eth3", "tcp", 9, 9, "ESTABLISHED"), "established"),
    (("9.9.9.9", "1.1.1.1", "eth3", "tcp", 9, 9, "NEW"), "whitelist"),
    (("9.9.1.1", "1.1.1.1", "eth3", "tcp", 9, 22, "NEW"), "set"),
    (("8.8.8.8", "1.1.1.1", "eth3", "tcp", 9, 22, "NEW"), "set"),
    (("5.5.5.5", "224.0.0.1", "eth3", "udp", 9, 9, "NEW"), "trap_exit"),
    (("5.5.5.5", "1.1.1.1", "br0", "udp", 9, 9, "NEW"), "trap_exit"),
    (("230.1.1.1", "1.1.1.1", "eth3", "udp", 53, 9, "NEW"), "spoofed"),
    (("5.5.5.5", "1.1.1.1", "eth3", "udp", 853, 9, "NEW"), "dns_reply"),
    (("5.5.5.5", "1.1.1.1", "eth3", "tcp", 9, 22, "NEW"), "service"),
    (("5.5.5.5", "1.1.1.1", "eth3", "udp", 9, 22, "NEW"), "trap"),
    (("5.5.5.5", "1.1.1.1", "eth3", "tcp", 9, 5005, "NEW"), "passive_range"),
    (("2001:db8::9", "2002::1", "eth3", "tcp", 9, 22, "NEW"), "set"),
    (("2001:db8::7", "2002::1", "eth3", "tcp", 9, 22, "NEW"), "whitelist"),
    (("fe80::1", "2002::1", "eth3", "tcp", 9, 9, "NEW"), "local"),
    (("::1", "2002::1", "eth3", "tcp", 9, 9, "NEW"), "local"),
    (("2003::1", "ff02::1", "eth3", "udp", 9, 9, "NEW"), "trap_exit"),
    (("2003::1", "2002::1", "eth3", "udp", 9, 9, "NEW"), "trap"),
]


@pytest.fixture(scope="module")
def frames(spark):
    packets = spark.createDataFrame(
        [(i, i, *c) for i, (c, _) in enumerate(CASES)],
        "pkt_id long, ts_us long, src string, dst string, iface string, proto string, sport int, dport int, state string",
    )
    return packets, spark.createDataFrame(SETS, "set_name string, net string")


def reasons(df):
    return [r.reason for r in df.orderBy("pkt_id").collect()]


def test_rule_order(frames):
    out = classify_packets(*frames, CFG)
    assert reasons(out) == [want for _, want in CASES]
    rows = {r.pkt_id: r for r in out.collect()}
    assert rows[6].matched_set == "FirewallBlock" and rows[15].matched_set == "FirewallBlock6"
    assert all(r.ban == (r.reason == "trap") for r in rows.values())


def test_switches(frames):
    off = classify_packets(*frames, dataclasses.replace(CFG, enabled=False))
    assert set(reasons(off)) == {"disabled"}
    quiet = classify_packets(*frames, dataclasses.replace(CFG, autoban=False))
    assert reasons(quiet)[7] == "service" and not any(r.ban for r in quiet.collect())


def test_forward_direction(frames):
    out = reasons(classify_packets(*frames, CFG, forward=True))
    assert out[0] == "default" and out[2] == "local" and out[6] == "set" and out[17] == "default"
    trapped = reasons(classify_packets(*frames, dataclasses.replace(CFG, forward_protection=True), forward=True))
    assert trapped[0] == "spoofed" and trapped[3] == "trap"


def test_detectors_only_touch_service_packets(frames, spark):
    hits = spark.createDataFrame([(12,), (13,)], "pkt_id long")
    out = reasons(classify_packets(*frames, CFG, brute=hits))
    assert out[12] == "bruteforce" and out[13] == "trap"
    over = spark.createDataFrame([(12,)], "conn_id long")
    assert reasons(classify_packets(*frames, CFG, brute=hits, over_limit=over))[12] == "connlimit"
