"""Run registered queries on Spark and their SQL on DuckDB, and compare the rows.

usage: python check_queries.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import time

import duckdb

from cohortspark.plans.catalog import ORACLES, QUERIES
from cohortspark.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def canonical(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "" if v is None else "nan"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf: str) -> tuple[bool, str, float]:
    t0 = time.time()
    df = QUERIES[name](spark, sf)
    got_cols, got_rows = df.columns, [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if name not in ORACLES:
        return True, f"rows only: {len(got_rows)}", took
    cur = con.execute(ORACLES[name])
    want_cols = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    want_rows = cur.fetchall()
    a, b = rows_of(got_cols, got_rows), rows_of(want_cols, want_rows)
    if a[0] != b[0]:
        return False, f"columns {a[0]} != {b[0]}", took
    widths = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date"}
    odd = [f"{c}:{t}/{kinds[c]}" for c, t in df.dtypes if widths.get(kinds[c]) != t]
    note = f" types differ: {odd}" if odd else ""
    if a[1] != b[1]:
        diff = [(x, y) for x, y in zip(a[1], b[1]) if x != y][:2]
        return False, f"rows {len(a[1])} vs {len(b[1])}; {a[0]}; first {diff}{note}", took
    return True, f"{len(a[1])} rows{note}", took


def main() -> int:
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="/root/testdata/sf0.01")
    p.add_argument("names", nargs="*")
    args = p.parse_args()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.sf)
    bad = 0
    for name in args.names or QUERIES:
        try:
            ok, text, took = compare(spark, con, name, args.sf)
        except Exception as e:  # noqa: BLE001 - report every query
            ok, text, took = False, f"{type(e).__name__}: {str(e)[:600]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {took:6.2f}s {name}: {text}", flush=True)
    print(f"{bad} failures")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
