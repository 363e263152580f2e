"""Run registered queries against their checking SQL: `python tools/check.py [sf_dir] [name ...]`."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if value is None:
        return "\0"
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows), sorted(columns)


def main() -> None:
    from paperloom.plans.catalog import ORACLES, QUERIES
    from paperloom.plans.fixtures import TABLES
    from paperloom.session import local_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = args or list(QUERIES)
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name in names:
        start = time.time()
        df = QUERIES[name](spark, sf)
        got = [tuple(r) for r in df.collect()]
        took = time.time() - start
        if name not in ORACLES:
            print(f"rows  {name:28s} {len(got):8d} rows {took:6.2f}s", flush=True)
            continue
        start = time.time()
        cur = con.execute(ORACLES[name])
        want = cur.fetchall()
        duck = time.time() - start
        a, ca = rows_of(df.columns, got)
        b, cb = rows_of([d[0] for d in cur.description], want)
        ok = a == b and ca == cb
        bad += not ok
        print(f"{'ok   ' if ok else 'DIFF '} {name:28s} {len(a):8d} rows {took:6.2f}s oracle {duck:6.2f}s", flush=True)
        if not ok:
            print("   columns", ca, cb, "rows", len(a), len(b))
            sa, sb = set(a), set(b)
            print("   spark only", [x for x in a if x not in sb][:3])
            print("   oracle only", [x for x in b if x not in sa][:3])
    print(f"{len(names)} queries, {bad} differ")


if __name__ == "__main__":
    main()
