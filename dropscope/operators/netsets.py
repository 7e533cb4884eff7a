"""Address-in-network joins, network merging and set comparison.

Membership is an equi-join: an address becomes one row per prefix length that occurs in the sets, keyed
by its masked network. Addresses are made distinct first, so a busy source is probed once. Short
prefixes, where one network may cover a large share of all addresses, are salted by the address hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dropscope.functions import ip as IP

SALTS = 16
# Prefixes shorter than these are salted.
SHORT_V4, SHORT_V6 = 24, 56


def with_bits(df: DataFrame, col: str) -> DataFrame:
    """Adds ``family``, ``plen`` and ``bits``; rows that are no address or network go."""
    rows = IP.computed(df, family=IP.family(col), plen=IP.prefix_len(col), bits=IP.address_bits(col))
    return rows.filter(F.col("bits").isNotNull() & F.col("plen").isNotNull())


def _is_short() -> Column:
    return F.col("plen") < F.when(F.col("family") == 4, SHORT_V4).otherwise(SHORT_V6)


def keyed_sets(net_set: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """``set_name, family, plen, key, salt`` and the columns ``more``; short prefixes once per salt."""
    rows = with_bits(net_set.select(*dict.fromkeys(["set_name", "net", *more])), "net").select(
        "set_name", "family", "plen", IP.network_key("bits", "plen").alias("key"), *more
    )
    salts = F.when(_is_short(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.distinct().withColumn("salt", F.explode(salts))


def expand_prefixes(ips: DataFrame, lengths: DataFrame, col: str = "ip") -> DataFrame:
    """One row per prefix length in use: ``ip, family, plen, key, salt``.

    ``lengths`` holds at most two rows, one per family, each an array of at most 129 lengths; that is
    the size bound of the broadcast. A network expands only to lengths up to its own.
    """
    probe = with_bits(ips.select(col).distinct(), col).join(F.broadcast(lengths), "family")
    return probe.select(
        col,
        "family",
        F.explode(F.filter("lens", lambda n: n <= F.col("plen"))).alias("len"),
        "bits",
    ).select(
        col,
        "family",
        F.col("len").alias("plen"),
        IP.network_key("bits", "len").alias("key"),
    ).withColumn("salt", F.when(_is_short(), F.pmod(F.xxhash64(col), F.lit(SALTS))).otherwise(0).cast("int"))


def prefix_lengths(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("family").agg(F.collect_set("plen").alias("lens"))


def matches(ips: DataFrame, net_set: DataFrame, col: str = "ip") -> DataFrame:
    """Distinct ``(ip, set_name)`` pairs where some network of the set contains the address or network."""
    keyed = keyed_sets(net_set)
    probe = expand_prefixes(ips, prefix_lengths(keyed), col)
    hit = probe.join(keyed, ["family", "plen", "key", "salt"])
    # At most one row per address and set name leaves the aggregate.
    return hit.select(col, "set_name").distinct()


def matched_nets(ips: DataFrame, net_set: DataFrame, col: str = "ip") -> DataFrame:
    """As ``matches``, with the entry that matched: ``ip, set_name, _net, salt``. An entry counts once, however many rows of
    ``net_set`` repeat it; ``salt`` spreads the addresses of a short prefix."""
    keyed = keyed_sets(net_set.select("set_name", "net").distinct(), ("net",)).withColumnRenamed("net", "_net")
    probe = expand_prefixes(ips, prefix_lengths(keyed), col)
    return probe.join(keyed, ["family", "plen", "key", "salt"]).select(col, "set_name", "_net", "salt")


def ip_lookup(ips: DataFrame, net_set: DataFrame, col: str = "ip", as_of: int | None = None) -> DataFrame:
    """Which sets hold each address: ``ip, blocked, lists`` (lists bounded by the number of sets). With ``as_of``,
    only entries valid at that second count."""
    if as_of is not None:
        from dropscope.operators.membership import live_at

        net_set = live_at(net_set, as_of)
    found = matches(ips, net_set, col).groupBy(col).agg(F.array_sort(F.collect_set("set_name")).alias("lists"))
    out = ips.select(col).distinct().join(found, col, "left")
    none = F.array().cast("array<string>")
    return out.select(
        col, F.col("lists").isNotNull().alias("blocked"), F.coalesce("lists", none).alias("lists")
    )


def new_attackers(log_ips: DataFrame, net_set: DataFrame) -> DataFrame:
    """Status of attacking addresses: ``global`` (main set), ``already`` (VPN set) or ``new``."""
    sets = net_set.filter(F.col("set_name").isin("FirewallBlock", "VPNBlock"))
    looked = ip_lookup(log_ips, sets)
    return looked.select(
        "ip",
        F.when(F.array_contains("lists", "FirewallBlock"), "global")
        .when(F.array_contains("lists", "VPNBlock"), "already")
        .otherwise("new")
        .alias("status"),
    )


def redundant_bans(bans: DataFrame, main: DataFrame) -> DataFrame:
    """VPN bans with ``action``: ``removed`` if the main set covers them, else ``kept``."""
    covered = matches(bans.select("net"), main, "net").select("net").distinct().withColumn("_c", F.lit(True))
    out = bans.select("net").distinct().join(covered, "net", "left")
    return out.select("net", F.when(F.col("_c"), "removed").otherwise("kept").alias("action"))


def restorable_bans(stored: DataFrame, net_set: DataFrame) -> DataFrame:
    """Stored bans that are in neither the main nor the VPN set and so must be added again."""
    return new_attackers(stored.select("ip"), net_set).filter(F.col("status") == "new").select("ip")


# ---- merging --------------------------------------------------------------------------------------


def net_ranges(nets: DataFrame, col: str = "net") -> DataFrame:
    """IPv4 networks as inclusive number ranges; entries that are no network go."""
    rows = IP.computed(nets.filter(~IP.is_v6(col)).select(col), base=IP.v4_to_long(col), plen=IP.prefix_len(col))
    rows = rows.filter(F.col("base").isNotNull() & F.col("plen").isNotNull())
    lo, hi = IP.v4_block("base", "plen")
    return rows.select(lo.alias("lo"), hi.alias("hi"))


def _islands(rows: DataFrame, group: list[Column]) -> DataFrame:
    """Join overlapping and adjacent ranges inside each group."""
    keys = [f"_g{i}" for i in range(len(group))]
    g = rows.select("lo", "hi", *[c.alias(k) for c, k in zip(group, keys)])
    order = W.partitionBy(*keys).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    start = F.when(F.col("lo") <= before + 1, 0).otherwise(1)
    marked = g.withColumn("_s", start).withColumn("_i", F.sum("_s").over(order))
    return marked.groupBy(*keys, "_i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("lo", "hi")


def _stitch(ranges: DataFrame, inner: int, outer: int) -> DataFrame:
    """Join ranges that touch an edge of a 2^inner block, inside blocks of 2^outer addresses.

    A range that touches no edge is a group of its own, so only edge ranges meet in a group.
    """
    mask = F.lit(2**inner - 1)
    edge = (F.col("lo").bitwiseAND(mask) == 0) | (F.col("hi").bitwiseAND(mask) == mask)
    return _islands(ranges, [F.shiftright("lo", outer), F.when(edge, F.lit(-1)).otherwise(F.col("lo"))])


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """Disjoint, non-adjacent ranges covering the same addresses.

    Ranges are cut at /16 edges and joined per /16, which holds at most 131,071 distinct pieces. Only
    ranges touching an edge go on: at most 512 per /8, then at most 512 in all. No step sees the list whole.
    """
    first, last = F.shiftright("lo", 16), F.shiftright("hi", 16)
    blocks = ranges.distinct().select("lo", "hi", F.explode(F.sequence(first, last)).alias("_b"))
    start = F.col("_b") * 65536
    pieces = blocks.select(
        F.greatest("lo", start).alias("lo"), F.least(F.col("hi"), start + 65535).alias("hi")
    ).distinct()
    per16 = _islands(pieces, [F.shiftright("lo", 16)])
    return _stitch(_stitch(per16, 16, 24), 24, 32)


def merge_cidrs(nets: DataFrame, col: str = "net") -> DataFrame:
    return merge_ranges(net_ranges(nets, col))


def minimal_cidrs(ranges: DataFrame) -> DataFrame:
    """Fewest networks covering each range.

    A block of 2^k addresses belongs to the answer when it lies inside the range and its parent does
    not; per k only the first and the last aligned block of the range can qualify.
    """
    rows = ranges.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("k"))
    size = F.expr("shiftleft(1L, k)")
    lo, hi = F.col("lo"), F.col("hi")
    left = lo + F.pmod(-lo, F.col("size"))
    right = (hi + 1) - F.pmod(hi + 1, F.col("size")) - F.col("size")
    rows = rows.withColumn("size", size).withColumn("start", F.explode(F.array_distinct(F.array(left, right))))
    parent = F.col("start") - F.pmod(F.col("start"), F.col("size") * 2)
    inside = (F.col("start") >= lo) & (F.col("start") + F.col("size") - 1 <= hi)
    parent_inside = (parent >= lo) & (parent + F.col("size") * 2 - 1 <= hi) & (F.col("k") < 32)
    return rows.filter(inside & ~parent_inside).select(
        F.concat(IP.long_to_v4(F.col("start")), F.lit("/"), (F.lit(32) - F.col("k")).cast("string")).alias("net"),
        F.col("start").alias("lo"),
        (F.col("start") + F.col("size") - 1).alias("hi"),
    )


def distinct_nets(nets: DataFrame, col: str = "net") -> DataFrame:
    return nets.select(col).distinct()


def set_changes(old: DataFrame, new: DataFrame, col: str = "net") -> DataFrame:
    """Entries that appear in only one of two versions: ``net, change``. One shuffle, no join."""
    both = old.select(col, F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(
        new.select(col, F.lit(0).alias("o"), F.lit(1).alias("n"))
    )
    seen = both.groupBy(col).agg(F.max("o").alias("o"), F.max("n").alias("n")).filter(F.col("o") != F.col("n"))
    return seen.select(col, F.when(F.col("n") == 1, "added").otherwise("removed").alias("change"))
