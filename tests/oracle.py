"""Run registered queries on Spark and their check SQL on DuckDB and compare them.

Usage: python -m tests.oracle [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


TYPE_NAMES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
              "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}


def compare(spark_fn, sql: str, spark, sf_dir: str, con) -> tuple[bool, str]:
    df = spark_fn(spark, sf_dir)
    got_cols, got = norm([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    want_types = {d[0]: TYPE_NAMES.get(str(d[1]), str(d[1])) for d in cur.description}
    want_cols, want = norm(cur.fetchall(), [d[0] for d in cur.description])
    got_types = dict(df.dtypes)
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    bad = {c: (got_types[c], want_types[c]) for c in got_cols if got_types[c] != want_types[c]}
    note = f" types {bad}" if bad else ""
    if got != want:
        a, b = set(got), set(want)
        return False, (f"rows {len(got)} vs {len(want)}; only spark {sorted(a - b, key=repr)[:2]}; "
                       f"only check {sorted(b - a, key=repr)[:2]}{note}")
    return not bad, f"{len(got)} rows{note}"


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--module")
    args = ap.parse_args()
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    import importlib

    from gradeloom import catalog
    from gradeloom.session import local_session
    if args.module:
        importlib.import_module(f"gradeloom.catalog.{args.module}")
    else:
        catalog.load()
    spark = local_session("oracle")
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = duck(sf_dir)
    failed = 0
    for name in args.names or list(catalog.QUERIES):
        started = time.time()
        try:
            if name in catalog.CHECKS:
                ok, note = compare(catalog.QUERIES[name], catalog.CHECKS[name], spark, sf_dir, con)
            else:
                ok, note = True, f"{catalog.QUERIES[name](spark, sf_dir).count()} rows (no check SQL)"
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:900]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - started:6.2f}s {note}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
