"""Operators against brute force on small random inputs, hot keys included."""

import ipaddress
import random
from collections import defaultdict

from pyspark.sql import functions as F

from dropscope.config import Config
from dropscope.functions import ip as IP
from dropscope.operators import abuse, deltas, detect, flows, netsets, retention
from dropscope.sources import store as S


def addresses(rng, n):
    out = []
    for _ in range(n):
        if rng.random() < 0.6:
            out.append(str(ipaddress.ip_address(rng.choice([0, 0xC6330000, 0x0A000000, 0xFFFFFF00]) + rng.randrange(256))))
        else:
            a = ipaddress.ip_address((0x20010DB8 << 96) + rng.choice([0, 1 << 80, 1 << 64]) + rng.randrange(300))
            out.append(rng.choice([a.compressed, a.exploded, a.compressed.upper()]))
    return out


def test_v6_forms(spark):
    texts = ["::", "::1", "1::", "2001:db8::8:800:200c:417a", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8", "fe80::1:2"]
    bad = ["1:2:3", "1::2::3", "12345::", "g::1", "1:2:3:4:5:6:7:8:9", "::1.2.3.400"]
    df = spark.createDataFrame([(t,) for t in texts + bad], "ip string")
    got = {r[0]: r[1] for r in df.select("ip", IP.v6_to_hex("ip")).collect()}
    assert {t: got[t] for t in texts} == {t: f"{int(ipaddress.ip_address(t)):032x}" for t in texts}
    assert all(got[b] is None for b in bad)


def test_containment_equals_brute_force(spark):
    rng = random.Random(1)
    ips = addresses(rng, 300)
    nets = []
    for a in addresses(rng, 120):
        top = 128 if ":" in a else 32
        p = rng.choice([0, 3, 8, 16, 23, 24, 29, top, top, 47, 64, 65, 120]) % (top + 1)
        nets.append((rng.choice(["A", "B", "C"]), str(ipaddress.ip_network(f"{a}/{p}", strict=False)) if p < top else a))
    got = {
        (r.ip, r.set_name)
        for r in netsets.matches(
            spark.createDataFrame([(i,) for i in ips], "ip string"),
            spark.createDataFrame(nets, "set_name string, net string"),
        ).collect()
    }
    want = {
        (i, s) for i in ips for s, n in nets
        if ipaddress.ip_address(i).version == ipaddress.ip_network(n).version and ipaddress.ip_address(i) in ipaddress.ip_network(n)
    }
    assert got == want


def test_merge_and_minimal_cover(spark):
    rng = random.Random(2)
    nets = [f"{ipaddress.ip_address(rng.choice([0, 2**32 - 2**20, 0x0A00FF00, 0x0AFFFF00]) + rng.randrange(1500))}/{rng.choice([32, 31, 30, 28, 24, 22, 16, 9])}" for _ in range(150)]
    nets += ["11.0.0.0/16", "11.1.0.0/16", "11.255.0.0/16", "12.0.0.0/16", "12.0.0.0/16", "bad", "300.1.1.1"]
    df = spark.createDataFrame([(n,) for n in nets], "net string")
    good = [ipaddress.ip_network(n, strict=False) for n in nets if n not in ("bad", "300.1.1.1")]
    want = {str(n) for n in ipaddress.collapse_addresses(good)}
    merged = netsets.merge_cidrs(df)
    assert {r.net for r in netsets.minimal_cidrs(merged).collect()} == want
    rows = sorted((r.lo, r.hi) for r in merged.collect())
    assert all(b[0] > a[1] + 1 for a, b in zip(rows, rows[1:]))


def test_everything_merges_into_one(spark):
    df = spark.createDataFrame([("0.0.0.0/1",), ("128.0.0.0/1",)], "net string")
    assert [r.net for r in netsets.minimal_cidrs(netsets.merge_cidrs(df)).collect()] == ["0.0.0.0/0"]


def test_deltas_carry_over_days_and_gaps(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for ip in ("hot", "b", "c"):
        prev, total = 0, 0
        for t in sorted(rng.sample(range(0, 20 * 86400, 1800), 400 if ip == "hot" else 15)):
            cur = rng.randrange(50) if rng.random() < 0.05 else prev + rng.randrange(4)
            d = cur if cur < prev else cur - prev
            if d > 0:
                want[(t, ip)] = d
            rows.append((t, ip, "trap", cur))
            prev = cur
    df = spark.createDataFrame(rows, "run_ts long, ip string, list_type string, packets long")
    assert {(r.run_ts, r.ip): r["count"] for r in deltas.ip_delta(df).collect()} == want


def test_one_address_in_two_lists_keeps_two_counters(spark):
    rows = [(1, "a", "trap", 5), (1, "a", "main", 100), (2, "a", "trap", 6), (2, "a", "main", 101)]
    df = spark.createDataFrame(rows, "run_ts long, ip string, list_type string, packets long")
    got = {(r.run_ts, r.list_type): r["count"] for r in deltas.ip_delta(df).collect()}
    assert got == {(1, "trap"): 5, (1, "main"): 100, (2, "trap"): 1, (2, "main"): 1}


def test_trailing_count_with_a_hot_source_and_ties(spark):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        src = "hot" if rng.random() < 0.4 else f"s{rng.randrange(30)}"
        us = rng.randrange(0, 200) * 1000000 + rng.choice([0, 0, 1, 500000, 999999])
        rows.append((i, src, us))
    for seconds in (1, 5, 60):
        df = spark.createDataFrame(rows, "id long, src string, ts_us long")
        got = {r.id: r.recent for r in detect.trailing_count(df, ["src"], "ts_us", seconds).collect()}
        by = defaultdict(list)
        for _, s, t in rows:
            by[s].append(t)
        assert got == {i: sum(t - seconds * 1000000 <= x <= t for x in by[s]) for i, s, t in rows}


def test_peaks_and_over_limit(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        src = "hot" if rng.random() < 0.4 else f"s{rng.randrange(20)}"
        a = rng.randrange(0, 900) * 1000000
        rows.append((i, src, "tcp", rng.choice([22, 8080]), a, a + rng.randrange(0, 200) * 1000000))
    cfg = Config(bypass_conn_tcp=(8080,), conn_limit=5, conn_limit_custom=7)
    df = spark.createDataFrame(rows, "conn_id long, src string, proto string, dport int, start_us long, end_us long")
    at, held = {}, defaultdict(list)
    for i, s, _, p, a, e in sorted(rows, key=lambda r: (r[4], r[0])):
        held[s] = [x for x in held[s] if x > a]
        at[i] = len(held[s]) + 1
        if at[i] <= (7 if p == 8080 else 5):
            held[s].append(e)
    over = {i for i, s, _, p, a, e in rows if at[i] > (7 if p == 8080 else 5)}
    assert over and {r.conn_id: r.open for r in detect.over_limit_opens(df, cfg).collect()} == {i: at[i] for i in over}
    want = defaultdict(int)
    for i, s, _, p, *_ in rows:
        k = (s, "custom" if p == 8080 else "default")
        want[k] = max(want[k], at[i])
    got = {(r.src, r.port_class): (r.peak, r.over) for r in detect.peak_connections(df, cfg).collect()}
    assert got == {k: (v, v > (7 if k[1] == "custom" else 5)) for k, v in want.items()}
    free = Config(bypass_conn_tcp=(8080,), conn_limit_custom=0)
    rows = detect.peak_connections(df, free).filter("port_class = 'custom'").collect()
    assert rows and not any(r.over for r in rows)


def greedy(times, timeout):
    out, end = [], None
    for t in sorted(times):
        if end is None or t >= end:
            out.append(t)
            end = t + timeout
    return out


def test_ban_intervals(spark):
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.5 else f"s{rng.randrange(9)}", 1700000000 + rng.randrange(400000)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "src string, ts long")
    by = defaultdict(set)
    for s, t in rows:
        by[s].add(t)
    for timeout in (1, 777, 86400, 200000):
        got = defaultdict(list)
        for r in detect.ban_intervals(df, timeout).collect():
            assert r.end_s == r.start_s + timeout
            got[r.src].append(r.start_s)
        assert {s: sorted(v) for s, v in got.items()} == {s: greedy(t, timeout) for s, t in by.items()}


def test_rollup_keeps_totals_and_open_days(spark):
    as_of = 1706659200 + 5000
    rows = [(as_of - k * 3571, "L", 3) for k in range(200)]
    df = spark.createDataFrame(rows, "timestamp long, list_name string, count long")
    out = retention.compact(df, ["list_name"], as_of)
    assert out.agg(F.sum("count")).first()[0] == 600
    day = lambda d: {r[0]: r[1] for r in d.groupBy(F.floor(F.col("timestamp") / 86400)).agg(F.sum("count")).collect()}
    assert day(out) == day(df)
    # The trailing 24 hours still hold exactly the rows they held before.
    last = lambda d: sorted(r[0] for r in d.filter(F.col("timestamp") > as_of - 86400).select("timestamp").collect())
    assert last(out) == last(df)
    assert retention.compact(out, ["list_name"], as_of).exceptAll(out).count() == 0


def test_retention_ignores_null_addresses(spark):
    rows = [(0, None, 100, "trap"), (0, "a", 100, "trap")]
    df = spark.createDataFrame(rows, "timestamp long, ip string, count long, list_type string")
    vip = spark.createDataFrame([(None,), ("z",)], "ip string")
    assert retention.retain_ip_drops(df, vip, 1706659200).count() == 0


def test_port_history_never_inserts_and_matches_whole_entries(spark):
    info = spark.createDataFrame(
        [("a.a.a.a", "NL", 1, "d", 5, 8080, "8080/tcp")],
        S.table_schema("ip_info"),
    )
    packets = spark.createDataFrame(
        [(10, "a.a.a.a", 80, "tcp"), (11, "a.a.a.a", 8080, "tcp"), (9, "b.b.b.b", 22, "tcp")],
        "ts_us long, ip string, port int, proto string",
    )
    once = flows.apply_port_history(info, packets, 99)
    assert [tuple(r) for r in once.collect()] == [("a.a.a.a", "NL", 1, "d", 99, 8080, "8080/tcp,80/tcp")]
    assert flows.apply_port_history(once, packets, 99).collect() == once.collect()


def test_new_hits_compare_whole_addresses(spark):
    facts = spark.createDataFrame(
        [(10, "1.2.3.4", 1, "trap"), (10, "1.2.3.4/32", 2, "trap"), (10, "1.2.3.40", 50, "trap"), (5, "1.2.3.4", 9, "trap")],
        S.table_schema("ip_drops"),
    )
    cands = spark.createDataFrame([("1.2.3.4", 5)], "host string, last_sent long")
    assert [tuple(r) for r in abuse.new_hits(cands, facts).collect()] == [("1.2.3.4", 3)]


def test_queue_reports_an_address_once(spark):
    now = 1706659200
    facts = spark.createDataFrame(
        [(now - 10, "1.1.1.1", 7, "trap"), (now - 10, "1.1.1.1", 9, "main"), (now - 10, "2.2.2.2", 4, "trap"), (now - 99999, "3.3.3.3", 4, "trap")],
        S.table_schema("ip_drops"),
    )
    info = spark.createDataFrame([("1.1.1.1", "NL", 1, "d", 5, 22, None), ("2.2.2.2", "NL", 1, "d", 5, 22, "")], S.table_schema("ip_info"))
    reports = spark.createDataFrame([("2.2.2.2", now - 604800)], "ip string, last_sent long")
    q = abuse.report_queue(facts, info, reports, Config(), now)
    got = {(r.ip, r["class"]): (r.status, r.comment) for r in q.collect()}
    assert got[("1.1.1.1", "brute")][0] == "reported" and "[22]" in got[("1.1.1.1", "brute")][1]
    assert got[("1.1.1.1", "static")] == ("skipped_cooldown", None)
    assert got[("2.2.2.2", "brute")][1].endswith("[+ 4 new hits since last report]")
    assert ("3.3.3.3", "brute") not in got
    assert abuse.reports_after(q, now).count() == 2


def test_single_scan_candidates_equal_the_class_queries(spark):
    rng = random.Random(7)
    now = 1706659200
    ips = [f"1.1.1.{i}" for i in range(40)] + [f"2001:db8::{i:x}" for i in range(20)] + ["9.0.0.0/8", "8.8.8.8/32", "2001:db9::/32"]
    facts = spark.createDataFrame(
        [(now - rng.randrange(100000), rng.choice(ips), rng.randrange(1, 9), rng.choice(["trap", "main", "geo", "manual"])) for _ in range(3000)],
        S.table_schema("ip_drops"),
    )
    info = spark.createDataFrame(
        [(i, "NL", 1, "d", 5, rng.choice([None, 0, 22, 23]), rng.choice([None, "", "23/tcp", "9/udp"])) for i in ips if rng.random() < 0.7],
        S.table_schema("ip_info"),
    )
    cfg = Config()
    svc = tuple(dict.fromkeys(cfg.tcp_services + cfg.udp_services))
    got = {(r["class"], r.ip, r.total, r.ports) for r in abuse.all_candidates(facts, info, cfg, now).collect()}
    want = set()
    for fam in (4, 6):
        for kind, df in (
            ("brute", abuse.abuse_bruteforce(facts, info, svc, now, fam)),
            ("scan", abuse.abuse_scanners(facts, info, svc, now, fam)),
            ("unknown", abuse.unknown_port_sources(facts, info, now, fam)),
            ("static", abuse.abuse_static(facts, now, fam)),
        ):
            want |= {(kind, r.ip, r.total, r.ports) for r in df.collect()}
    for kind, df in (("net", abuse.abuse_subnets(facts, now)), ("geo", abuse.abuse_geo(facts, now))):
        want |= {(kind, r.ip, r.total, r.ports) for r in df.collect()}
    assert got == want


def test_bruteforce_bans_restart_the_count(spark):
    rng = random.Random(8)
    rows = []
    for i in range(2500):
        src = "hot" if rng.random() < 0.4 else f"s{rng.randrange(12)}"
        us = rng.randrange(0, 1500) * 1000000 + rng.choice([0, 0, 0, 1, 400000])
        rows.append((i, src, rng.choice(["tcp", "udp"]), rng.choice([22, 443, 53, 51515, 9]), "NEW" if rng.random() < 0.95 else "ESTABLISHED", us))
    cfg = Config(brute_hits=4, brute_seconds=30, ban_timeout=45, tcp_services=(22, 443), udp_services=(53, 51515))
    df = spark.createDataFrame(rows, "pkt_id long, src string, proto string, dport int, state string, ts_us long")
    want, seen, until = set(), defaultdict(list), {}
    for i, src, proto, port, state, us in sorted(rows, key=lambda r: (r[5], r[0])):
        ok = port in (cfg.tcp_services if proto == "tcp" else cfg.udp_services)
        if state != "NEW" or not ok or us < until.get(src, 0):
            continue
        if sum(us - 30000000 <= t for t in seen[(src, proto)]) >= 4:
            want.add((src, us // 1000000))
            until[src] = (us // 1000000 + 45) * 1000000
        else:
            seen[(src, proto)].append(us)
    got = {(r.src, r.start_s) for r in detect.bruteforce_bans(df, cfg).collect()}
    assert len(want) > 10 and got == want


def test_refused_openings_hold_nothing(spark):
    """Twenty long openings, fifteen admitted; when those have closed, fourteen more fit although the refused would still be open."""
    sec = 1_000_000
    rows = [(i, "a", i * sec, (100 if i < 15 else 900) * sec) for i in range(20)] + [(100 + i, "a", (200 + i) * sec, 800 * sec) for i in range(16)]
    df = spark.createDataFrame(rows, "conn_id long, src string, start_us long, end_us long")
    got = detect.over_limit_opens(df, Config(conn_limit=15)).collect()
    assert {r.conn_id for r in got} == {15, 16, 17, 18, 19, 115} and all(r.open == 16 for r in got)


def test_a_busy_source_is_cut_where_nothing_is_open(spark):
    rng = random.Random(9)
    rows = []
    for i in range(4000):
        start = rng.randrange(0, 20_000) * 1_000_000
        rows.append((i, "a" if i % 3 else f"s{i % 7}", start, start + rng.randrange(0, 6) * 1_000_000))
    df = spark.createDataFrame(rows, "conn_id long, src string, start_us long, end_us long")
    got = {(r.src, r.start_us): r.busy for r in detect.busy_stretches(df).collect()}
    want, latest, begun = {}, {}, {}
    by_start = defaultdict(int)
    for _, s, a, e in rows:
        by_start[s, a] = max(by_start[s, a], e)
    for (s, a), e in sorted(by_start.items(), key=lambda x: x[0][1]):
        if latest.get(s, -1) <= a:
            begun[s] = a
        want[s, a] = begun[s]
        latest[s] = max(latest.get(s, -1), e)
    assert got == want and len({b for (s, _), b in want.items() if s == "a"}) > 100
