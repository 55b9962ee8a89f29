"""Spark-vs-DuckDB comparison used by the tests and by hand.

Run: ``python tests/harness.py [sf_dir] [name ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return v.item()
        except Exception:
            return v
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir, rel_tol=0.0):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    out = {"name": name, "spark_rows": len(srows), "oracle_rows": len(drows),
           "spark_s": round(t1 - t0, 2)}
    if sorted(scols) != sorted(dcols):
        out["error"] = f"columns differ: {sorted(scols)} vs {sorted(dcols)}"
        return out
    a, b = _rows(scols, srows), _rows(dcols, drows)
    if len(a) != len(b):
        out["error"] = "row count differs"
        return out
    bad = 0
    first = None
    for x, y in zip(a, b):
        if x != y:
            ok = len(x) == len(y) and all(
                (p == q) or (isinstance(p, float) and isinstance(q, float)
                             and rel_tol and abs(p - q) <= rel_tol * max(1.0, abs(p), abs(q)))
                for p, q in zip(x, y))
            if not ok:
                bad += 1
                first = first or (x, y)
    if bad:
        out["error"] = f"{bad} rows differ; first: {first}"
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from tallyspark.session import build_session
    from tallyspark.plans import QUERIES, ORACLE
    spark = build_session("harness", cores=8, shuffle_partitions=8)
    con = duck(sf_dir)
    failed = 0
    for name, fn in QUERIES.items():
        if names and name not in names:
            continue
        if name not in ORACLE:
            try:
                n = fn(spark, sf_dir).count()
                print(f"ROWS  {name}: {n} rows (no oracle)")
            except Exception as e:  # noqa: BLE001
                failed += 1
                print(f"FAIL  {name}: {type(e).__name__}: {str(e)[:400]}")
            continue
        try:
            r = compare(spark, con, name, fn, ORACLE[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            failed += 1
            print(f"FAIL  {name}: {type(e).__name__}: {str(e)[:600]}")
            continue
        if "error" in r:
            failed += 1
            print(f"FAIL  {name}: {r}")
        else:
            print(f"OK    {name}: {r['spark_rows']} rows {r['spark_s']}s")
    print(f"failed={failed}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
