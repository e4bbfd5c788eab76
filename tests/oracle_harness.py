"""Run catalogue queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck_con(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    pdf = pdf[cols]
    out = []
    for rec in pdf.itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    spdf = sdf.toPandas()
    t1 = time.time()
    dpdf = con.sql(sql).df()
    t2 = time.time()
    sc, sr = rows_of(spdf)
    dc, dr = rows_of(dpdf)
    ok = sc == dc and len(sr) == len(dr) and sr == dr
    info = {"name": name, "ok": ok, "rows": len(sr), "oracle_rows": len(dr),
            "spark_s": round(t1 - t0, 2), "duck_s": round(t2 - t1, 2)}
    if not ok:
        if sc != dc:
            info["cols"] = (sc, dc)
        else:
            diff_s = [r for r in sr if r not in set(dr)][:3]
            diff_d = [r for r in dr if r not in set(sr)][:3]
            info["spark_only"] = diff_s
            info["oracle_only"] = diff_d
    return info


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from calltrail.session import get_spark
    import __spark_entry__ as E
    spark = get_spark()
    con = duck_con(sf_dir)
    qs, orc = E.queries(), E.oracle_sql()
    bad = 0
    for n in (names or list(qs)):
        if n not in orc:
            print({"name": n, "ok": None, "note": "no oracle"})
            continue
        try:
            info = compare(spark, con, n, qs[n], orc[n], sf_dir)
        except Exception as e:  # report and continue
            info = {"name": n, "ok": False, "error": repr(e)[:600]}
        bad += not info["ok"]
        print(info, flush=True)
    print("FAILED", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
