"""VPN jobs: bans outlive their set, runs can be repeated, covered bans leave and come back."""

from pyspark.sql import functions as F

from dropscope.plans import vpn
from dropscope.sources import store as S

BAD = "TLS Error: TLS handshake failed"


def log(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "line string")


def publish(spark, store, name, *nets):
    S.publish_set(spark.createDataFrame([(name, n) for n in nets] or [], "set_name string, net string"), store, name)


def nets(spark, store, name=vpn.VPN_SET):
    return sorted(r.net for r in S.read_versioned(spark, store, f"set_{name}").collect())


def test_scan_restores_bans_and_repeats_nothing(spark, tmp_path):
    store = str(tmp_path)
    publish(spark, store, vpn.MAIN_SET, "5.0.0.0/8")
    publish(spark, store, vpn.VPN_SET, "1.1.1.1")
    vpn.import_bans(log(spark, "2.2.2.2 # old", "5.5.5.5", "999.1.1.1", "2.2.2.2"), store, 1)
    lines = log(spark, f"{BAD} from 1.1.1.1", f"{BAD} 5.9.9.9", f"{BAD} 3.3.3.3:17", f"{BAD} 3.3.3.3:18", "ok 4.4.4.4", f"{BAD} 300.1.1.1", f"{BAD} 2.2.2.2")
    first = vpn.vpn_scan(lines, store, 10).first().asDict()
    assert first == {"banned": 1, "restored": 1, "optimized": 1, "skipped": 2}
    assert nets(spark, store) == ["1.1.1.1", "2.2.2.2", "3.3.3.3"]
    bans = sorted(map(tuple, S.read_versioned(spark, store, "vpn_bans").collect()))
    assert bans == [("2.2.2.2", None), ("3.3.3.3", 10), ("5.5.5.5", None)]
    versions = [S.current_version(spark, store, t) for t in ("vpn_bans", "set_VPNBlock")]
    again = vpn.vpn_scan(lines, store, 20).first().asDict()
    assert again["banned"] == again["restored"] == 0 and again["skipped"] == 3
    assert versions == [S.current_version(spark, store, t) for t in ("vpn_bans", "set_VPNBlock")]


def test_run_lost_before_the_set_ends_the_same(spark, tmp_path):
    store, lines = str(tmp_path), log(spark, f"{BAD} 3.3.3.3", f"{BAD} 6.6.6.6")
    vpn.vpn_scan(lines.filter(F.lit(False)), store, 1)
    # The list was published, the set was not.
    S.publish(spark.createDataFrame([("3.3.3.3", 10), ("6.6.6.6", 10)], "ip string, since long"), store, "vpn_bans", 10)
    vpn.vpn_scan(lines, store, 10)
    assert nets(spark, store) == ["3.3.3.3", "6.6.6.6"]
    trend = vpn.ban_trend(S.read_versioned(spark, store, "vpn_bans")).collect()
    assert [(r["run_ts"], r["new"], r["total"]) for r in trend] == [(10, 2, 2)]


def test_covered_bans_leave_and_come_back(spark, tmp_path):
    store = str(tmp_path)
    vpn.vpn_scan(log(spark, f"{BAD} 3.3.3.3", f"{BAD} 4.4.4.4"), store, 10)
    publish(spark, store, vpn.MAIN_SET, "3.0.0.0/8")
    assert vpn.vpn_cleanup(spark, store, 20).first().asDict() == {"kept": 1, "removed": 1}
    assert nets(spark, store) == ["4.4.4.4"]
    publish(spark, store, vpn.MAIN_SET, "8.0.0.0/8")
    assert vpn.vpn_scan(log(spark, "quiet"), store, 30).first()["restored"] == 1
    assert nets(spark, store) == ["3.3.3.3", "4.4.4.4"]


def test_nothing_published_yet(spark, tmp_path):
    store = str(tmp_path)
    assert vpn.vpn_cleanup(spark, store, 1).first().asDict() == {"kept": 0, "removed": 0}
    assert vpn.vpn_scan(log(spark), store, 1).first()["banned"] == 0
