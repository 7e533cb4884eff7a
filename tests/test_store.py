"""Store, publication and whole jobs."""

import json

from pyspark.sql import functions as F

from catalog.views import AS_OF, Views
from dropscope.config import Config
from dropscope.plans import dashboard as D
from dropscope.plans import refresh as R
from dropscope.sources import store as S
from dropscope.sources import text as T

SF = "/root/testdata/sf0.001"


def nets(spark, *rows):
    return spark.createDataFrame(list(rows), "set_name string, net string")


def test_publish_guard_and_versions(spark, tmp_path):
    store = str(tmp_path)
    assert S.publish_set(nets(spark, ("AutoBan", "1.1.1.1"), ("AutoBan", "1.1.1.2")), store, "AutoBan") == 1
    assert S.publish_set(nets(spark, ("AutoBan", "1.1.1.3")), store, "AutoBan", min_rows=2) == 1
    assert S.publish_set(nets(spark, ("AutoBan", "1.1.1.3")), store, "AutoBan") == 2
    assert [r.net for r in S.read_versioned(spark, store, "set_AutoBan").collect()] == ["1.1.1.3"]
    assert S.read_versioned(spark, store, "set_AutoBan", version=1).count() == 2


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "ip string, last_sent long")
    new = spark.createDataFrame([("b", 9), ("c", 9)], "ip string, last_sent long")
    once = S.upsert(old, new, ["ip"])
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 9), ("c", 9)]
    assert sorted(S.upsert(once, new, ["ip"]).collect()) == sorted(once.collect())


def test_unban_clears_both_sets_and_latest_event_wins(spark):
    sets = nets(spark, ("AutoBan", "5.5.5.5"), ("Blacklist", "5.5.5.5"), ("Blacklist", "6.6.6.6"), ("FirewallBlock", "5.5.5.5"))
    req = spark.createDataFrame(
        [(1, "5.5.5.5", "unban"), (1, "7.7.7.7", "ban"), (2, "7.7.7.7", "unban"), (3, "2001::1", "ban"), (4, "127.0.0.1", "ban")],
        "event_time long, ip string, action string",
    )
    got = sorted(map(tuple, S.apply_ban_events(sets, S.ban_requests(req)).collect()))
    assert got == [("Blacklist", "6.6.6.6"), ("Blacklist6", "2001::1"), ("FirewallBlock", "5.5.5.5")]


def test_too_short_download_keeps_the_old_set(spark, tmp_path):
    store = str(tmp_path)
    long = spark.range(60).select(F.concat(F.lit("9.9."), F.col("id").cast("string"), F.lit(".0/24")).alias("line"))
    assert R.refresh_blocklist(long, store, 4, AS_OF) == 1
    assert R.refresh_blocklist(long.limit(3), store, 4, AS_OF) == 1
    assert R.read_sets(spark, store).count() == 4  # 0-31, 32-47, 48-55, 56-59


def test_disabled_countries_empty_the_sets(spark, tmp_path):
    lines = spark.createDataFrame([("nl", "1.2.0.0/16"), ("nl", "2001:db8::/32"), ("de", "9.0.0.0/8")], "country string, line string")
    R.refresh_zones(lines, str(tmp_path), Config(banned_countries=("NL",)), AS_OF)
    assert sorted(r.net for r in R.read_sets(spark, str(tmp_path)).collect()) == ["1.2.0.0/16", "2001:db8::/32"]
    R.refresh_zones(lines, str(tmp_path), Config(), AS_OF)
    assert R.read_sets(spark, str(tmp_path)).count() == 0


def test_jobs_end_to_end(spark, tmp_path):
    v, store = Views(spark, SF), str(tmp_path)
    S.publish(v.ip_info, store, "ip_info", AS_OF)
    S.publish(v.abuse_reports, store, "abuse_reports", AS_OF)
    packets = T.parse_packets(v.packet_text)
    R.statistics_run(spark, store, T.parse_rule_counters(v.rule_lines), v.set_snapshots, packets, AS_OF)
    tables = S.load_store(spark, store)
    assert all(t.count() for t in tables.values())
    R.enrichment_run(spark, store, T.parse_reputation(v.reputation_json), AS_OF)
    info = S.read_versioned(spark, store, "ip_info")
    assert info.groupBy("ip").count().filter("count > 1").count() == 0
    assert info.count() >= v.ip_info.count()
    first = {r.status: r.n for r in R.report_run(spark, store, Config(), AS_OF).collect()}
    again = {r.status: r.n for r in R.report_run(spark, store, Config(), AS_OF).collect()}
    assert first.get("reported", 0) > 0 and "reported" not in again
    R.retention_run(spark, store, AS_OF)
    assert S.load_store(spark, store)["drops"].agg(F.sum("count")).first() == tables["drops"].agg(F.sum("count")).first()


def test_dashboard_document(spark):
    v = Views(spark, SF)
    store = {"drops": v.drops, "ip_drops": v.ip_drops, "ip_info": v.ip_info}
    doc = json.loads(D.dashboard(store, v.size_history, Config(), AS_OF).first().document)
    assert set(doc["tables"]) == set(D.table_names()) and len(doc["tables"]) == 33
    assert doc["lifetime"] == v.drops.agg(F.sum("count")).first()[0]
    ranks = [r["rank"] for r in doc["tables"]["trap_all"]]
    assert ranks == list(range(1, 11))
    newest = [r["newest"] for r in doc["tables"]["daily"]]
    assert newest == sorted(newest, reverse=True)
    assert set(doc["averages"]) == {"hourly", "daily", "monthly", "yearly"}
