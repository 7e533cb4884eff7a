"""Registration of queries with their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalog.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register ``fn(views)`` under ``name``; ``check`` is DuckDB SQL over the same views."""

    def wrap(fn: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if check is not None:
            CHECKS[name] = with_views(check)
        return fn

    return wrap


def v4num(x: str) -> str:
    """DuckDB number of a dotted quad (prefix ignored)."""
    a = f"split_part({x},'/',1)"
    parts = [f"CAST(split_part({a},'.',{i + 1}) AS BIGINT)*{256 ** (3 - i)}" for i in range(4)]
    return "(" + "+".join(parts) + ")"


def v6hex(x: str) -> str:
    """DuckDB 32 hex digits of an IPv6 text (prefix ignored)."""
    a = f"lower(split_part({x},'/',1))"
    left = f"list_filter(string_split(split_part({a},'::',1),':'), lambda e: e<>'')"
    right = f"list_filter(string_split(CASE WHEN contains({a},'::') THEN split_part({a},'::',2) ELSE '' END,':'), lambda e: e<>'')"
    pad = "lambda e: lpad(e,4,'0')"
    return (
        f"(array_to_string(list_transform({left}, {pad}),'') || repeat('0000', 8-len({left})-len({right}))"
        f" || array_to_string(list_transform({right}, {pad}),''))"
    )


def plen(x: str) -> str:
    return f"CASE WHEN contains({x},'/') THEN CAST(split_part({x},'/',2) AS INT) WHEN contains({x},':') THEN 128 ELSE 32 END"


def hits(ips: str, sets: str, col: str = "ip") -> str:
    """DuckDB CTE bodies ``h(ip,set_name)``: containment by number ranges (v4) and hex prefixes (v6)."""
    return f"""
n4 AS (SELECT set_name, lo - lo % (1::BIGINT << (32-p)) AS lo, lo - lo % (1::BIGINT << (32-p)) + (1::BIGINT << (32-p)) - 1 AS hi
  FROM (SELECT set_name, {v4num('net')} AS lo, {plen('net')} AS p FROM {sets} WHERE NOT contains(net,':')) t),
n6 AS (SELECT set_name, {v6hex('net')} AS hx, {plen('net')} AS p FROM {sets} WHERE contains(net,':')),
a AS (SELECT DISTINCT {col} AS ip FROM {ips}),
h AS (SELECT DISTINCT ip, set_name FROM (SELECT ip, {v4num('ip')} AS x FROM a WHERE NOT contains(ip,':')) t JOIN n4 ON x BETWEEN lo AND hi
  UNION SELECT DISTINCT ip, set_name FROM (SELECT ip, {v6hex('ip')} AS x FROM a WHERE contains(ip,':')) t JOIN n6 ON left(x, p//4) = left(hx, p//4))"""
