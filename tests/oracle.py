"""Compares registered Spark queries with their oracle SQL in DuckDB, value by value.

Run as a script: python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from datetime import date, datetime
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple((type(v).__name__, v) for v in (_plain(r[i]) for i in order)) for r in rows)


def compare(spark, con, fn, sql, sf_dir) -> tuple[str | None, int]:
    """A description of the first difference, or None; and the number of Spark rows."""
    df = fn(spark, sf_dir)
    mine = df.collect()
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    theirs = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}", len(mine)
    a, b = _rows(df.columns, mine), _rows(names, theirs)
    if a == b:
        return None, len(mine)
    only_a, only_b = list((a - b).items())[:1], list((b - a).items())[:1]
    return f"rows {len(mine)} vs {len(theirs)}\n  spark {only_a}\n  sql   {only_b}", len(mine)


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from trailmark.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark, con, bad = local_session(), connect(sf_dir), 0
    sql = oracle_sql()
    for name, fn in queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            if name in sql:
                problem, n = compare(spark, con, fn, sql[name], sf_dir)
            else:
                problem, n = None, len(fn(spark, sf_dir).collect())
        except Exception as error:  # noqa: BLE001
            problem, n = f"{type(error).__name__}: {str(error)[:700]}", -1
        kind = "value" if name in sql else "rows"
        flag = "ok " if problem is None else "BAD"
        print(f"{flag} {name:28s} {kind} rows={n} {time.time() - start:.2f}s", flush=True)
        if problem:
            bad += 1
            print("   ", problem, flush=True)
        elif n == 0:
            print("    (no rows)", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
