"""Runs registered queries and their check SQL side by side: ``python -m tests.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return tuple(_norm(i) for i in x)
    if isinstance(x, dict):
        return tuple((k, _norm(v)) for k, v in x.items())
    return x


def _bag(rows, cols, names) -> Counter:
    at = [cols.index(n) for n in names]
    return Counter(tuple((type(_norm(r[i])).__name__, _norm(r[i])) for i in at) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> str:
    """``''`` when both sides agree, else what differs."""
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    got = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "" if got else "no rows"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    names = sorted(cols)
    a, b = _bag(got, df.columns, names), _bag(want, cols, names)
    if a != b:
        return f"{len(got)} vs {len(want)} rows; only spark {list((a - b))[:2]}; only check {list((b - a))[:2]}; columns {names}"
    return "" if want else "empty on both sides"


def main() -> None:
    import __spark_entry__ as entry
    from tests.conftest import session

    args = sys.argv[1:]
    sf_dir = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = [a for a in args if "/" not in a] or list(entry.queries())
    spark, con = session(), connect(sf_dir)
    bad = 0
    for n in names:
        t = time.time()
        try:
            out = compare(spark, con, n, sf_dir)
        except Exception as e:  # noqa: BLE001
            out = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(out)
        kind = "D" if n in entry.oracle_sql() else "R"
        print(f"{'FAIL' if out else 'ok  '} {kind} {time.time() - t:6.2f}s {n} {out}", flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")


if __name__ == "__main__":
    main()
