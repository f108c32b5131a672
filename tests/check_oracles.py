"""Compare registered queries with their SQL on DuckDB. Usage: python tests/check_oracles.py [sf] [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else ("-0" if v == 0 and math.copysign(1, v) < 0 else v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    key = lambda t: tuple((x is None, f"{x:.5e}" if isinstance(x, float) else str(x)) for x in t)
    return sorted(out, key=key), [columns[i] for i in order]


def close(a, b, tol=1e-7):
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None or isinstance(a, str) or isinstance(b, str):
            return a == b
        return abs(a - b) <= tol * max(1.0, abs(a), abs(b))
    return a == b and type(a) is type(b)


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got, cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want, wcols = rows_of(names, cur.fetchall())
    if cols != wcols:
        return f"columns {cols} vs {wcols}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}", len(got)
    exact = 0
    for g, w in zip(got, want):
        if not all(close(a, b) for a, b in zip(g, w)):
            return f"value {dict(zip(cols, g))} vs {dict(zip(cols, w))}", len(got)
        exact += g == w
    return ("" if exact == len(got) else f"(inexact {len(got) - exact})"), len(got)


def main() -> int:
    from basketry.session import local_session
    import __spark_entry__ as e

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(cores=8)
    con = duck(sf_dir)
    oracles = e.oracle_sql()
    bad = 0
    for name, fn in e.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        t = time.time()
        try:
            if name in oracles:
                msg, n = compare(spark, con, fn, oracles[name], sf_dir)
            else:
                msg, n = "(no oracle)", len(fn(spark, sf_dir).collect())
        except Exception as ex:  # report and go on
            msg, n = f"ERROR {type(ex).__name__}: {str(ex)[:600]}", -1
        ok = msg == "" or msg.startswith("(")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:38s} rows={n:6d} {time.time() - t:6.2f}s {msg}", flush=True)
    print(f"{bad} failures")
    return bad


if __name__ == "__main__":
    sys.exit(main())
