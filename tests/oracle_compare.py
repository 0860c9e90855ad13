"""Run registered Spark queries next to their DuckDB oracle and compare.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Doubles are compared after rounding to 9 significant digits; rows are sorted.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if v == 0:
            return 0.0
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    return v


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    s_cols = sdf.columns
    t1 = time.time()
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    t2 = time.time()
    ok_cols = sorted(s_cols) == sorted(d_cols)
    a, b = canon(s_rows, s_cols), canon(d_rows, d_cols)
    diff = sum(1 for x, y in zip(a, b) if x != y) + abs(len(a) - len(b))
    status = "OK" if ok_cols and diff == 0 else "MISMATCH"
    print(f"{name:24s} {status:8s} spark={len(s_rows)} duck={len(d_rows)} diff={diff} "
          f"cols_ok={ok_cols} ts={t1 - t0:.1f}s td={t2 - t1:.1f}s", flush=True)
    if status != "OK":
        if not ok_cols:
            print("   spark cols", sorted(s_cols), "\n   duck  cols", sorted(d_cols))
        shown = 0
        for x, y in zip(a, b):
            if x != y and shown < 3:
                print("   S", x[:12], "\n   D", y[:12])
                shown += 1
    return status == "OK"


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as E
    from greenscan.session import get_spark
    spark = get_spark()
    con = duck(sf_dir)
    qs, oracle = E.queries(), E.oracle_sql()
    bad = []
    for name in names or sorted(qs):
        if name not in oracle:
            t0 = time.time()
            n = qs[name](spark, sf_dir).count()
            print(f"{name:24s} ROWS     spark={n} ({time.time() - t0:.1f}s, no oracle)", flush=True)
            continue
        try:
            if not compare(spark, con, name, qs[name], oracle[name], sf_dir):
                bad.append(name)
        except Exception as e:  # report and continue
            print(f"{name:24s} ERROR    {type(e).__name__}: {str(e)[:400]}", flush=True)
            bad.append(name)
    print("BAD:", bad)


if __name__ == "__main__":
    main()
