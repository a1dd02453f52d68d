"""Run registered queries next to their SQL checks: check.py [sf_dir] [name or prefix* ...]."""

import fnmatch
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from blastradius.plans.estate import TABLES  # noqa: E402
from blastradius.queries import ORACLES, QUERIES  # noqa: E402
from blastradius.session import local_session  # noqa: E402


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(r[i] for i in order) for r in rows), key=lambda t: tuple((v is None, str(v)) for v in t)
    )


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:] or ["*"]
    spark = local_session("check")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    bad = []
    for name, build in QUERIES.items():
        if not any(fnmatch.fnmatch(name, p) for p in pats):
            continue
        t0 = time.time()
        try:
            df = build(spark, sf)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            t1 = time.time()
            if name not in ORACLES:
                print(f"{name:28s} rows={len(got[1])} spark={t1 - t0:.1f}s  NO CHECK", flush=True)
                continue
            cur = con.execute(ORACLES[name])
            want = rows_of([d[0] for d in cur.description], cur.fetchall())
            t2 = time.time()
            ok = got == want
            types = sorted((f.name, f.dataType.simpleString()) for f in df.schema)
            wtypes = sorted((d[0], str(d[1])) for d in cur.description)
            print(f"{name:28s} {'ok ' if ok else 'BAD'} rows={len(got[1])}/{len(want[1])} spark={t1 - t0:.1f}s duckdb={t2 - t1:.1f}s", flush=True)
            loose = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE"}
            for (n, a), (_, b) in zip(types, wtypes):
                if loose.get(a) != b:
                    print("     type", n, a, b)
            if not ok:
                bad.append(name)
                print("    ", got[0], want[0])
                a, b = set(map(str, got[1])), set(map(str, want[1]))
                print("     only spark ", sorted(a - b)[:4])
                print("     only duckdb", sorted(b - a)[:4])
        except Exception as e:
            bad.append(name)
            print(f"{name:28s} ERROR {type(e).__name__}: {str(e)[:1500]}", flush=True)
    print("BAD:", bad)
    sys.exit(bool(bad))


main()
