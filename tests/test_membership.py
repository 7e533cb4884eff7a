"""Holds, as-of lookups and set membership over time against plain Python."""

import ipaddress
import random

import numpy as np
import pytest

from dropscope.operators import classify, detect, holds, membership, netsets
from dropscope.sources import store as S

EVENTS = membership.EVENT_SCHEMA


def _fold(seconds, timeout):
    out, free = [], None
    for t in sorted(set(seconds)):
        if free is None or t >= free:
            out.append((t, t + timeout))
            free = t + timeout
    return out


@pytest.mark.parametrize("timeout", [1, 7, 300, 86400, 200_000])
def test_ban_intervals_equal_the_fold(spark, timeout):
    rnd = random.Random(timeout)
    sources = {"a": [rnd.randrange(-90_000, 400_000) for _ in range(3000)], "b": [5], "c": list(range(86_000, 87_500)), None: [1, 2, 9]}
    df = spark.createDataFrame([(s, t) for s, ts in sources.items() for t in ts] + [("a", None)], "src STRING, ts BIGINT")
    got = sorted((str(r[0]), r[1], r[2]) for r in detect.ban_intervals(df, timeout).collect())
    assert got == sorted((str(s), *i) for s, ts in sources.items() for i in _fold(ts, timeout))


def test_one_source_is_many_tasks(spark):
    """Two million seconds of one source without a gap: as many pieces as days, and the fold's result."""
    df = spark.range(2_000_000).selectExpr("'x' AS src", "id AS ts")
    bans = detect.ban_intervals(df, 3700)
    assert [(r[1], r[2]) for r in bans.orderBy("start_s").collect()] == [(t, t + 3700) for t in range(0, 2_000_000, 3700)]
    assert df.select((df["ts"] / 86400).cast("int")).distinct().count() == 24


def test_exit_tables():
    rnd = random.Random(1)
    for _ in range(200):
        x = np.array(sorted(rnd.sample(range(300), rnd.randint(1, 60))))
        end = x + np.array([rnd.randint(1, 80) for _ in x])
        bounds, exits = holds._exits(x, end)
        for free in range(0, 310, 7):
            want = free
            for a, b in zip(x, end, strict=True):
                if a >= want:
                    want = b
            k = np.searchsorted(bounds, free)
            assert (exits[k] if k < len(bounds) else free) == want


def test_last_at_equals_a_scan(spark):
    rnd = random.Random(2)
    marks = [(rnd.choice("ab"), rnd.randrange(-50, 4000), rnd.randrange(9)) for _ in range(60)] + [("a", 3, None)]
    points = [(rnd.choice("abc"), rnd.randrange(-60, 4100)) for _ in range(500)]
    got = holds.last_at(spark.createDataFrame(points, "k STRING, t BIGINT"), spark.createDataFrame(marks, "k STRING, t BIGINT, v INT"), ["k"], "t", "v", 100)

    def last(k, t):
        seen = [(u, v) for x, u, v in marks if x == k and u <= t and v is not None]
        return max(seen)[1] if seen else None

    assert {tuple(r) for r in got.collect()} == {(k, t, last(k, t)) for k, t in points} and got.count() == len(set(points))


def _spans(events, timeouts):
    """Intervals by one pass over the events in time order."""
    rank = {"flush": 0, "rebuild": 0, "add": 1, "remove": 2}
    now, lives, out = dict(timeouts), {}, []

    def close(entry, t):
        added, end = lives.pop(entry)
        if min(end, t) > added:
            out.append((*entry, added, None if min(end, t) == float("inf") else min(end, t)))

    for t, name, net, action, timeout in sorted(events, key=lambda e: (e[0], rank[e[3]], e[4] if e[3] == "rebuild" else 0)):
        for entry in [e for e, (_, end) in lives.items() if end <= t]:
            close(entry, t)
        if action in ("flush", "rebuild"):
            for entry in [e for e in lives if e[0] == name]:
                close(entry, t)
            if action == "rebuild":
                now[name] = timeout
        elif action == "remove" and (name, net) in lives:
            close((name, net), t)
        elif action == "add" and (name, net) not in lives:
            life = timeout if timeout is not None else now.get(name, 0)
            lives[name, net] = (t, t + life if life else float("inf"))
    for entry in list(lives):
        close(entry, float("inf"))
    return sorted(out, key=str)


def test_intervals_equal_a_pass_over_the_log(spark):
    rnd = random.Random(3)
    events = []
    for t in rnd.sample(range(1, 100_000), 600):  # one event a second: no ties
        name, action = rnd.choice("AB"), rnd.choice(["add"] * 6 + ["remove", "flush"] + ["rebuild"] * (t % 3 == 0))
        timeout = rnd.choice([0, 500, 5000]) if action == "rebuild" else rnd.choice([None, None, 300, 40_000])
        events.append((t, name, None if action in ("flush", "rebuild") else f"10.0.0.{rnd.randrange(4)}", action, timeout))
    got = membership.set_intervals(spark.createDataFrame(events, EVENTS), {"A": 900})
    assert sorted(map(tuple, got.collect()), key=str) == _spans(events, {"A": 900})


def test_ties_at_one_second(spark):
    events = [
        (10, "A", "10.0.0.1", "add", None), (10, "A", "10.0.0.1", "remove", None),  # never alive
        (10, "A", "10.0.0.2", "remove", None), (11, "A", "10.0.0.2", "add", 5), (11, "A", "10.0.0.2", "add", 9),  # the longer one
        (20, "A", None, "rebuild", 30), (20, "A", "10.0.0.3", "add", None),  # added to the new set
    ]
    got = sorted(map(tuple, membership.set_intervals(spark.createDataFrame(events, EVENTS)).collect()))
    assert got == [("A", "10.0.0.2", 11, 20), ("A", "10.0.0.3", 20, 50)]
    assert membership.set_intervals(spark.createDataFrame([], EVENTS)).collect() == []


def test_a_ban_of_a_minute(spark):
    """Blocks 59 seconds after it began and not after 61; a second offence in between does not extend it."""
    events = [(1000, "AutoBan", "198.51.100.7", "add", None), (1030, "AutoBan", "198.51.100.7", "add", None), (0, "GeoBlock", "198.51.100.0/24", "add", 40)]
    spans = membership.set_intervals(spark.createDataFrame(events, EVENTS), {"AutoBan": 60})
    ips = spark.createDataFrame([("198.51.100.7",)], "ip STRING")
    lists = lambda t: netsets.ip_lookup(ips, spans, as_of=t).first()["lists"]
    assert lists(1059) == ["AutoBan"] and lists(1061) == [] and lists(1060) == [] and lists(39) == ["GeoBlock"] and lists(999) == []
    packets = spark.createDataFrame([(i, "198.51.100.7", s * 1_000_000 + 999_999) for i, s in enumerate([999, 1000, 1059, 1060, 1061, 10])], "pkt_id INT, src STRING, ts_us BIGINT")
    got = {r["pkt_id"]: r["matched_set"] for r in classify.match_sets(packets, spans, ts="ts_us").collect()}
    assert got == {0: None, 1: "AutoBan", 2: "AutoBan", 3: None, 4: None, 5: "GeoBlock"}


def test_sets_at_equals_a_plain_lookup(spark):
    """Nested and overlapping networks, short prefixes, both families, repeated entries, lives without begin or end."""
    rnd = random.Random(11)
    nets = ["10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/24", "10.1.2.0/26", "10.1.2.3", "10.1.2.3/32", "2001:db8::/32", "2001:db8::7", "0.0.0.0/0", "bad"]
    spans = []
    for _ in range(150):
        t = rnd.choice([None, rnd.randrange(-2000, 4000)])
        spans.append((rnd.choice("ABC"), rnd.choice(nets), t, rnd.choice([None] + [(t or 0) + rnd.choice([1, 50, 2500])] * 9)))
    spans += [*spans[:40], (None, "10.0.0.0/8", 0, None), ("A", None, 0, None), ("A", "10.0.0.0/8", 100, 100)]
    ips = ["10.1.2.3", "10.1.2.77", "10.1.9.9", "10.200.0.1", "11.0.0.1", "2001:db8::7", "2001:db8::8", "2001:db9::1", "x", None]
    points = [(rnd.choice(ips), rnd.choice([None] + [rnd.randrange(-2500, 5000)] * 30)) for _ in range(2500)]
    points += points[:99]

    def holds_it(net, ip):
        try:
            return ipaddress.ip_address(ip) in ipaddress.ip_network(net)
        except ValueError:
            return False

    pairs = {(n, ip) for n in {s[1] for s in spans} - {None} for ip in {p[0] for p in points} - {None} if holds_it(n, ip)}
    want = {
        (ip, t, name) for ip, t in points for name, net, a, b in spans
        if t is not None and name is not None and (net, ip) in pairs and (a is None or a <= t) and (b is None or b > t)
    }
    got = membership.sets_at(
        spark.createDataFrame(points, "net STRING, at BIGINT"), spark.createDataFrame(spans, "set_name STRING, net STRING, added_at BIGINT, expires_at BIGINT"), "net", "at"
    ).collect()
    assert len(got) == len(want) > 1000 and set(map(tuple, got)) == want


def test_lives_are_not_repeated_for_each_address(spark):
    """250 addresses of a network with 400 lives; the shuffles see addresses and lives, not their product."""
    spans = spark.range(400).selectExpr("'GeoBlock' AS set_name", "'10.0.0.0/24' AS net", "id * 10 AS added_at", "id * 10 + 5 AS expires_at")
    packets = spark.range(500).selectExpr("id AS pkt_id", "concat('10.0.0.', id % 250) AS src", "id * 8000000 AS ts_us")
    fixed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in fixed}
    try:
        for k, v in fixed.items():
            spark.conf.set(k, v)
        out = classify.match_sets(packets, spans, ts="ts_us")
        got = {r["pkt_id"]: r["matched_set"] for r in out.collect()}
        nodes, rows = [out._jdf.queryExecution().executedPlan()], 0
        while nodes:
            node = nodes.pop()
            if node.metrics().contains("shuffleRecordsWritten"):
                rows += node.metrics().apply("shuffleRecordsWritten").value()
            nodes += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == {i: "GeoBlock" if i * 8 % 10 < 5 else None for i in range(500)}
    assert 1000 < rows < 20_000


def test_stored_sets_keep_their_times(spark):
    stored = spark.createDataFrame([("AutoBan", "10.0.0.1", 100, 160), ("Blacklist", "10.0.0.2", None, None)], S.SCHEMAS["net_set"])
    events = spark.createDataFrame([(150, "AutoBan", "10.0.0.1", "add"), (165, "AutoBan", "10.0.0.1", "add"), (120, "Blacklist", "10.0.0.3", "add")], "event_time BIGINT, set_name STRING, net STRING, action STRING")
    at = lambda t: sorted(map(tuple, S.apply_ban_events(stored, events, t, {"AutoBan": 60}).select("set_name", "net", "added_at", "expires_at").collect()))
    rest = [("Blacklist", "10.0.0.2", 0, None), ("Blacklist", "10.0.0.3", 120, None)]
    assert at(159) == [("AutoBan", "10.0.0.1", 100, 160), *rest] and at(160) == rest and at(170) == [("AutoBan", "10.0.0.1", 165, 225), *rest]
