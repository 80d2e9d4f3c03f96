"""Compare registered queries with their SQL: python tools/compare_sql.py [-sf DIR] [names...]"""
import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from shelfwise.session import local_session
from shelfwise.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, bool):
        return v
    if hasattr(v, "as_tuple"):
        return round(float(v), 9)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T00:00:00", "").replace("+00:00", "")
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("-sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{a.sf}/{t}.parquet'")
    bad = 0
    for name, fn in registry.QUERIES.items():
        if a.names and not any(n in name for n in a.names):
            continue
        try:
            t0 = time.time()
            df = fn(spark, a.sf)
            got = rows(df.columns, df.collect())
            dt = time.time() - t0
        except Exception as e:
            bad += 1
            print(f"ERROR {name}: {str(e)[:1500]}")
            continue
        if name not in registry.ORACLE:
            print(f"rows  {name}: {len(got)} ({dt:.1f}s)")
            continue
        try:
            t1 = time.time()
            cur = con.execute(registry.ORACLE[name])
            cols = [d[0] for d in cur.description]
            want = rows(cols, cur.fetchall())
            dd = time.time() - t1
        except Exception as e:
            bad += 1
            print(f"SQLERR {name}: {str(e)[:700]}")
            continue
        if sorted(cols) != sorted(df.columns):
            bad += 1
            print(f"COLS  {name}: {sorted(df.columns)} vs {sorted(cols)}")
        elif got != want:
            bad += 1
            gs, ws = set(got), set(want)
            diff = [x for x in got if x not in ws][:3], [x for x in want if x not in gs][:3]
            print(f"DIFF  {name}: {len(got)} vs {len(want)} rows {sorted(cols)}\n   spark {diff[0]}\n   sql   {diff[1]}")
        else:
            print(f"ok    {name}: {len(got)} rows ({dt:.1f}s, sql {dd:.1f}s)")
    print("bad:", bad)
    spark.stop()


main()
