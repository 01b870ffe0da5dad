"""Run registered queries in Spark and DuckDB and compare them.

    python -m editloom.checks.compare [sf] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time


def normal(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, int):
        return float(value)
    if hasattr(value, "as_tuple"):
        return round(float(value), 6)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(repr, r)))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    line = f"{name:34s} rows={len(got):7d} spark={t1 - t0:6.1f}s"
    if sql is None:
        return bool(got), line + " (rows only)"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    line += f" duck={time.time() - t1:6.1f}s"
    if sorted(cols) != sorted(df.columns):
        return False, line + f" COLUMNS {sorted(df.columns)} != {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    odd = [d[0] for d in cur.description if str(d[1]).startswith(("DECIMAL", "HUGEINT"))]
    if odd:
        return False, line + f" TYPES {odd}"
    if a == b:
        return bool(a), line + (" ok" if a else " EMPTY")
    only_a = [x for x in a if x not in set(b)][:2]
    only_b = [x for x in b if x not in set(a)][:2]
    return False, line + f" DIFF want={len(b)}\n   cols {sorted(cols)}\n   spark {only_a}\n   duck  {only_b}"


def main(argv):
    import duckdb
    from editloom.checks import all_queries
    from editloom.checks.fixtures import TABLES
    from editloom.session import local_session

    sf = argv[0] if argv else "0.001"
    sf_dir = os.path.join(os.environ.get("TESTDATA", "/root/testdata"), f"sf{sf}")
    queries, oracles = all_queries()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = []
    for name, fn in queries.items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        try:
            ok, line = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as exc:  # report and go on
            ok, line = False, f"{name:34s} ERROR {type(exc).__name__}: {str(exc)[:1500]}"
        print(("  " if ok else "X ") + line, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
