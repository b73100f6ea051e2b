"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_harness.py [sf_dir] [key ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return f"{round(v, 6):.6f}"
    if isinstance(v, (np.floating,)):
        return _norm(float(v))
    if isinstance(v, (np.integer,)):
        return str(int(v))
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return str(v)


def digest(rows: list[tuple], cols: list[str]) -> tuple[int, str]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return len(lines), hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


def compare(spark, con, sf_dir: str, key: str, queries, oracles) -> dict:
    t0 = time.time()
    sdf = queries[key](spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    ts = time.time() - t0
    res = {"key": key, "spark_rows": len(s_rows), "sec": round(ts, 2)}
    if key not in oracles:
        res["status"] = "rows-only"
        return res
    rel = con.execute(oracles[key])
    d_cols = [d[0] for d in rel.description]
    d_rows = rel.fetchall()
    res["duck_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = f"COLS spark={sorted(s_cols)} duck={sorted(d_cols)}"
        return res
    sd, dd = digest(s_rows, s_cols), digest(d_rows, d_cols)
    res["status"] = "ok" if sd == dd else "MISMATCH"
    if sd != dd:
        order_s = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
        order_d = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
        a = sorted("|".join(_norm(r[i]) for i in order_s) for r in s_rows)
        b = sorted("|".join(_norm(r[i]) for i in order_d) for r in d_rows)
        sa, sb = set(a), set(b)
        res["only_spark"] = sorted(sa - sb)[:3]
        res["only_duck"] = sorted(sb - sa)[:3]
        res["cols"] = sorted(s_cols)
    return res


def main(argv: list[str]) -> int:
    from insight import build_session
    import __spark_entry__ as entry

    QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    keys = argv[1:] or list(QUERIES)
    spark = build_session()
    con = duck(sf_dir)
    bad = 0
    for k in keys:
        try:
            r = compare(spark, con, sf_dir, k, QUERIES, ORACLES)
        except Exception as exc:  # report and keep going
            r = {"key": k, "status": f"ERROR {type(exc).__name__}: {str(exc)[:400]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{len(keys) - bad}/{len(keys)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
