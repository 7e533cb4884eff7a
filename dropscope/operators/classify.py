"""Which rule decides a packet. Works on packet tables; the first matching rule wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dropscope.config import Config
from dropscope.functions import ip as IP
from dropscope.functions.times import floor_div
from dropscope.operators.membership import sets_at
from dropscope.operators.netsets import matches

# Order in which the block sets are consulted.
SET_ORDER = ["FirewallBlock", "VPNBlock", "GeoBlock", "AutoBan", "Blacklist"]


def _first_set(hits: DataFrame, config: Config, key: list[str]) -> DataFrame:
    """One row per matched source (and second): ``white`` and the first block set that holds it."""
    col = key[0]
    order = [s for s in SET_ORDER if (s != "AutoBan" or config.autoban) and (s != "Blacklist" or config.manual)]
    rank, white = F.lit(None).cast("int"), F.col("set_name").isin("FirewallWhite", "FirewallWhite6")
    base = F.regexp_replace("set_name", "6$", "")
    for i, name in enumerate(order):
        rank = F.when(base == name, i).otherwise(rank)
    names = F.array(*[F.lit(s) for s in order])
    per = hits.groupBy(*key).agg(F.max(white).alias("white"), F.min(rank).alias("_rank"))
    found = F.get(names, F.col("_rank"))
    family = F.when(IP.is_v6(col) & found.isNotNull(), F.concat(found, F.lit("6"))).otherwise(found)
    return per.select(*key, "white", family.alias("matched_set"))


def match_sets(
    packets: DataFrame, net_set: DataFrame, config: Config | None = None, col: str = "src", ts: str | None = None
) -> DataFrame:
    """``packets`` plus ``white`` and ``matched_set``.

    Distinct sources are looked up once; the result has one row per source, so adaptive execution may
    split a hot source's packets over many tasks (or broadcast the lookup when it is measured small). With ``ts``
    (microseconds), ``net_set`` has ``added_at, expires_at`` and a packet meets the entries valid in its second.
    """
    white = F.coalesce("white", F.lit(False))
    if ts is None:
        found = _first_set(matches(packets, net_set, col), config or Config(), [col])
        return packets.join(found, col, "left").withColumn("white", white)
    timed = packets.withColumn("_second", floor_div(ts, 1000000))
    found = _first_set(sets_at(timed, net_set, col, "_second"), config or Config(), [col, "_second"])
    return timed.join(found, [col, "_second"], "left").select(*packets.columns, white.alias("white"), "matched_set")


def _rules_v4(config: Config, tcp: tuple[int, ...], udp: tuple[int, ...], forward: bool) -> list[tuple[Column, str, str]]:
    dst, iface, proto = F.col("dst"), F.col("iface"), F.col("proto")
    local = iface.startswith("tun") | IP.matches_any("src", IP.PRIVATE_V4, IP.LINK_LOCAL_V4)
    if not forward:
        local = local | IP.matches_any("src", IP.LOOPBACK_V4)
    rules = [
        (local, "pass", "local"),
        (F.col("state").isin("RELATED", "ESTABLISHED"), "pass", "established"),
        (F.col("white"), "pass", "whitelist"),
        (F.col("matched_set").isNotNull(), "drop", "set"),
    ]
    if forward and not config.forward_protection:
        return rules
    quiet = (iface == "br0") | iface.startswith("tun") | (proto == "icmp") | (dst == "255.255.255.255")
    rules += [
        (quiet | IP.matches_any("dst", IP.MULTICAST_V4), "pass", "trap_exit"),
        (IP.matches_any("src", IP.SPOOFED_V4), "drop", "spoofed"),
    ]
    return rules + _service_rules(config, tcp, udp)


def _rules_v6(config: Config, tcp: tuple[int, ...], udp: tuple[int, ...], forward: bool) -> list[tuple[Column, str, str]]:
    iface, proto = F.col("iface"), F.col("proto")
    local = iface.startswith("tun")
    if not forward:
        local = local | IP.matches_any("src", IP.LOOPBACK_V6, IP.LINK_LOCAL_V6)
    rules = [
        (local, "pass", "local"),
        (F.col("state").isin("RELATED", "ESTABLISHED"), "pass", "established"),
        (F.col("white"), "pass", "whitelist"),
        (F.col("matched_set").isNotNull(), "drop", "set"),
    ]
    if forward and not config.forward_protection:
        return rules
    multicast = IP.matches_any("dst", IP.MULTICAST_V6)
    quiet = (iface == "br0") | iface.startswith("tun") | proto.isin("icmp", "icmpv6") | multicast
    return rules + [(quiet, "pass", "trap_exit")] + _service_rules(config, tcp, udp)


def _service_rules(config: Config, tcp: tuple[int, ...], udp: tuple[int, ...]) -> list[tuple[Column, str, str]]:
    proto, dport = F.col("proto"), F.col("dport")
    service = F.lit(False)
    if tcp:
        service = service | ((proto == "tcp") & dport.isin(*tcp))
    if udp:
        service = service | ((proto == "udp") & dport.isin(*udp))
    rules = [
        (proto.isin("tcp", "udp") & F.col("sport").isin(53, 853), "pass", "dns_reply"),
        (service, "pass", "service"),
    ]
    if config.tcp_passive_range:
        lo, hi = config.tcp_passive_range
        rules.append(((proto == "tcp") & dport.between(lo, hi), "pass", "passive_range"))
    return rules


def _decide(rules: list[tuple[Column, str, str]]) -> Column:
    out = F.struct(F.lit("drop").alias("verdict"), F.lit("trap").alias("reason"))
    for cond, verdict, reason in reversed(rules):
        out = F.when(cond, F.struct(F.lit(verdict).alias("verdict"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def classify_packets(
    packets: DataFrame,
    net_set: DataFrame,
    config: Config,
    forward: bool = False,
    over_limit: DataFrame | None = None,
    brute: DataFrame | None = None,
    ts: str | None = None,
) -> DataFrame:
    """``packets`` plus ``verdict``, ``reason``, ``matched_set`` and ``ban``.

    ``over_limit`` (conn_id = pkt_id) and ``brute`` (pkt_id) are results of the detectors; packets to a
    service port named there are dropped before the service rule lets them pass. ``ban`` marks packets whose source
    is added to the dynamic set: brute-force packets always, trapped ones while automatic bans are on. ``ts``: see
    ``match_sets``.
    """
    if not config.enabled:
        off = {"verdict": "pass", "reason": "disabled"}
        cols = [F.lit(v).alias(k) for k, v in off.items()]
        return packets.select("*", *cols, F.lit(None).cast("string").alias("matched_set"), F.lit(False).alias("ban"))
    rows = match_sets(packets, net_set, config, ts=ts)
    v6 = IP.is_v6("src")
    decide = F.when(
        v6, _decide(_rules_v6(config, config.tcp_services, config.udp_services, forward))
    ).otherwise(_decide(_rules_v4(config, config.tcp_services, config.udp_services, forward)))
    if forward and not config.forward_protection:
        # Without forward protection nothing is trapped: what no rule took passes.
        free = F.struct(F.lit("pass").alias("verdict"), F.lit("default").alias("reason"))
        decide = F.when(decide["reason"] == "trap", free).otherwise(decide)
    if not config.ipv6:
        off6 = F.struct(F.lit("pass").alias("verdict"), F.lit("ipv6_off").alias("reason"))
        decide = F.when(v6, off6).otherwise(decide)
    rows = rows.withColumn("_d", decide)
    service = F.col("_d.reason") == "service"
    verdict, reason = F.col("_d.verdict"), F.col("_d.reason")
    if brute is not None and config.bruteforce:
        rows = rows.join(brute.select("pkt_id", F.lit(True).alias("_brute")), "pkt_id", "left")
        hit = service & F.coalesce("_brute", F.lit(False))
        verdict, reason = F.when(hit, "drop").otherwise(verdict), F.when(hit, "bruteforce").otherwise(reason)
    if over_limit is not None and config.connlimit:
        rows = rows.join(over_limit.select(F.col("conn_id").alias("pkt_id"), F.lit(True).alias("_over")), "pkt_id", "left")
        hit = service & F.coalesce("_over", F.lit(False))
        verdict, reason = F.when(hit, "drop").otherwise(verdict), F.when(hit, "connlimit").otherwise(reason)
    out = rows.select(
        *packets.columns,
        verdict.alias("verdict"),
        reason.alias("reason"),
        F.when(reason == "set", F.col("matched_set")).alias("matched_set"),
    )
    bans = ["trap", "bruteforce"] if config.autoban else ["bruteforce"]
    return out.withColumn("ban", F.col("reason").isin(*bans))


def offences(classified: DataFrame, ts: str = "ts_us") -> DataFrame:
    """Packets that open a ban, in whole seconds: the input of ``ban_intervals``."""
    return classified.filter(F.col("ban")).select("src", floor_div(ts, 1000000).alias("ts"))
