"""Parsers from text lines to typed rows. Every parser is one narrow, shuffle-free pass unless noted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dropscope.config import SET_TAGS
from dropscope.functions import ip as IP

# Patterns that mark input lines.
QUAD_START = r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
V6_START = r"^[0-9a-fA-F:]+"
QUAD_ANYWHERE = r"([0-9]{1,3}\.){3}[0-9]{1,3}"
ATTACK_PATTERNS = ("TLS handshake failed", "Bad encapsulated packet length")
BOGON_V4 = r"^(0\.0\.0\.0|127\.|10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|169\.254\.)"
BOGON_V6 = r"^(::1|fe80:)"

REPUTATION_SCHEMA = T.StructType(
    [
        T.StructField(
            "data",
            T.StructType(
                [
                    T.StructField("countryCode", T.StringType()),
                    T.StructField("abuseConfidenceScore", T.IntegerType()),
                    T.StructField("domain", T.StringType()),
                ]
            ),
        )
    ]
)


def first_word(line: Column | str) -> Column:
    return F.regexp_extract(IP._col(line), r"^\s*(\S+)", 1)


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Concatenation of text files, with the file each line came from."""
    return spark.read.text(paths).select(F.col("value").alias("line"), F.input_file_name().alias("source"))


def read_logs(spark: SparkSession, preferred: str, fallback: str) -> DataFrame:
    """Lines of the module log when that path exists, else of the system log."""
    path = spark._jvm.org.apache.hadoop.fs.Path(preferred)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return read_lines(spark, [preferred if fs.exists(path) else fallback])


def first_match(df: DataFrame, key: list[str], value: str, order: str = "line_no") -> DataFrame:
    """Value of the earliest row per key (combines on the map side)."""
    return df.groupBy(*key).agg(F.min_by(value, order).alias(value))


def parse_rule_counters(lines: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Packets per run and set: first matching rule of each chain, chains added, absent sets 0.

    ``lines``: run_ts, chain, line_no, line.
    """
    names = names or list(SET_TAGS)
    rules = lines.select(
        "run_ts",
        "chain",
        "line_no",
        F.regexp_extract("line", r"match-set (\w+)", 1).alias("set_name"),
        F.regexp_extract("line", r"^\s*(\d+)", 1).try_cast("long").alias("packets"),
    ).filter(F.col("packets").isNotNull() & (F.col("set_name") != ""))
    firsts = first_match(rules, ["run_ts", "chain", "set_name"], "packets")
    per_run = firsts.groupBy("run_ts").agg(
        *[F.coalesce(F.sum(F.when(F.col("set_name") == n, F.col("packets"))), F.lit(0)).alias(n) for n in names]
    )
    return per_run.unpivot("run_ts", list(names), "set_name", "packets").select("run_ts", "set_name", "packets")


def parse_set_dump(lines: DataFrame, tags: dict[str, str] | None = None, positive: bool = True) -> DataFrame:
    """``set_name, line`` listings → ``set_name, ip, packets, list_type``; lines without a counter are skipped."""
    tags = tags or SET_TAGS
    pattern = r"^(\S+) .*packets (\d+) "
    tag = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])
    rows = lines.filter(F.col("line").rlike(pattern) & F.col("set_name").isin(*tags)).select(
        "set_name",
        F.regexp_extract("line", pattern, 1).alias("ip"),
        F.regexp_extract("line", pattern, 2).try_cast("long").alias("packets"),
        tag[F.col("set_name")].alias("list_type"),
    )
    return rows.filter(F.col("packets") > 0) if positive else rows


def all_set_hits(dumps: list[DataFrame]) -> DataFrame:
    """Union of tagged dumps."""
    out = dumps[0]
    for d in dumps[1:]:
        out = out.unionByName(d)
    return out


def _uncolon(x: str) -> Column:
    return F.expr(f"if(endswith({x}, ':'), left({x}, length({x}) - 1), {x})")


def _dots(x: str) -> Column:
    return F.expr(f"length({x}) - length(replace({x}, '.', ''))")


def parse_packets(lines: DataFrame, since_us: int | None = None, col: str = "line") -> DataFrame:
    """Capture text → ``ts_us, ip, port, proto``; only lines with a source and a destination port survive.

    The words around the first ``>`` are source and destination, a trailing colon dropped. The address is
    the first four dotted parts of the source if it has them, else the first; the port is the last part
    of a destination with five (IPv4) or two (IPv6) dotted parts.
    """
    line = F.col(col)
    words = F.array_remove(F.split(F.translate(line, "\t", " "), " "), "")
    rows = IP.computed(lines.filter(line.contains(">")), _words=words)
    rows = IP.computed(rows, _at=F.array_position("_words", ">").cast("int")).filter(F.col("_at") > 1)
    rows = IP.computed(rows, _src=_uncolon("get(_words, _at - 2)"), _dst=_uncolon("get(_words, _at)"))
    digits = F.regexp_replace(F.substring_index("_dst", ".", -1), "[^0-9]", "")
    tcp = line.contains("Flags") | line.contains("seq") | line.contains("ack")
    rows = IP.computed(
        rows,
        ts_us=(F.get("_words", F.lit(0)).try_cast("decimal(20,6)") * 1000000).cast("long"),
        ip=F.when(_dots("_src") >= 3, F.substring_index("_src", ".", 4)).otherwise(F.substring_index("_src", ".", 1)),
        port=F.when(_dots("_dst").isin(1, 4), digits.try_cast("int")),
        proto=F.when(tcp, "tcp").otherwise("udp"),
    ).drop(col, "_words", "_at", "_src", "_dst")
    rows = rows.filter(((F.length("ip") >= 7) | F.col("ip").contains(":")) & (F.col("port") > 0))
    return rows if since_us is None else rows.filter(F.col("ts_us") > since_us)


def drop_bogons_v4(nets: DataFrame, col: str = "net") -> DataFrame:
    return nets.filter(~F.col(col).rlike(BOGON_V4))


def drop_bogons_v6(nets: DataFrame, col: str = "net") -> DataFrame:
    return nets.filter(~F.col(col).rlike(BOGON_V6))


def ingest_blocklist(lines: DataFrame, family: int = 4, col: str = "line") -> DataFrame:
    """Usable entries of raw list text. IPv4 keeps duplicates (merging removes them), IPv6 is distinct."""
    if family == 4:
        nets = lines.filter(F.col(col).rlike(QUAD_START)).select(first_word(col).alias("net"))
        return drop_bogons_v4(nets)
    nets = lines.filter(F.col(col).rlike(V6_START)).select(first_word(col).alias("net"))
    return drop_bogons_v6(nets.filter(F.col("net").contains(":"))).distinct()


def country_filter(zones: DataFrame, codes: list[str] | tuple[str, ...], col: str = "country") -> DataFrame:
    wanted = [c.lower() for c in codes]
    return zones.filter(F.lower(F.col(col)).isin(*wanted)) if wanted else zones.filter(F.lit(False))


def zone_country(source: Column | str) -> Column:
    """Country code from a zone file name such as ``…/nl-aggregated.zone``."""
    return F.lower(F.regexp_extract(IP._col(source), r"([A-Za-z]{2})[^/]*\.zone$", 1))


def ingest_zones(lines: DataFrame, countries: list[str] | tuple[str, ...], col: str = "line") -> DataFrame:
    """First word of every zone line of the wanted countries; no validation."""
    zones = lines if "country" in lines.columns else lines.withColumn("country", zone_country("source"))
    out = country_filter(zones, countries).select("country", first_word(col).alias("net"))
    return out.filter(F.col("net") != "")


def latest_valid(
    snapshots: DataFrame, as_of: int, max_age: int = 21600, min_size: int = 10, key: str = "source"
) -> DataFrame:
    """Newest snapshot per source that is fresh enough and larger than ``min_size``."""
    ok = snapshots.filter((F.lit(as_of) - F.col("fetched_at") < max_age) & (F.col("size") > min_size))
    rest = [c for c in snapshots.columns if c not in (key, "fetched_at")]
    # Equal fetch times: the larger struct wins, so the choice does not depend on row order.
    best = ok.groupBy(key).agg(F.max(F.struct("fetched_at", *rest)).alias("best"))
    return best.select(key, "best.*")


def extract_ipv4(lines: DataFrame, col: str = "line") -> DataFrame:
    """Every dotted quad anywhere in the text, distinct."""
    found = F.regexp_extract_all(F.col(col), F.lit(QUAD_ANYWHERE), F.lit(0))
    return lines.select(F.explode(found).alias("ip")).distinct()


def match_attack_lines(lines: DataFrame, patterns=ATTACK_PATTERNS, col: str = "line") -> DataFrame:
    return lines.filter(F.col(col).rlike("|".join(patterns)))


def attacker_ips(lines: DataFrame, patterns=ATTACK_PATTERNS, col: str = "line") -> DataFrame:
    return extract_ipv4(match_attack_lines(lines, patterns, col), col)


def parse_reputation(answers: DataFrame, col: str = "json") -> DataFrame:
    """Country, score and domain of an answer; ``ok`` is false when the country is missing."""
    d = F.from_json(F.col(col), REPUTATION_SCHEMA)["data"]
    rest = [c for c in answers.columns if c != col]
    return answers.select(
        *rest,
        d["countryCode"].alias("country"),
        d["abuseConfidenceScore"].alias("risk"),
        d["domain"].alias("domain"),
        F.coalesce(F.length(d["countryCode"]) > 0, F.lit(False)).alias("ok"),
    )
