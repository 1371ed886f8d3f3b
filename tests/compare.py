"""Run registered plans against their SQL in DuckDB: ``python tests/compare.py [pattern ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def normal(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "0.000000" if abs(v) < 5e-7 else f"{v:.6f}"
    if hasattr(v, "item"):
        return normal(v.item())
    return v


def kind(v):
    return None if v is None else "f" if isinstance(v, float) else "b" if isinstance(v, bool) else "i" if isinstance(v, int) else "s"


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark, con, plan, sql, sf_dir):
    df = plan(spark, sf_dir)
    names = sorted(df.columns)
    left = [tuple(r[c] for c in names) for r in df.collect()]
    if sql is None:
        return f"rows-only {len(left)}", not left
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != names:
        return f"columns differ: spark {names} / sql {sorted(cols)}", True
    at = [cols.index(c) for c in names]
    right = [tuple(r[i] for i in at) for r in cur.fetchall()]
    a, b = (Counter(tuple(normal(v) for v in r) for r in side) for side in (left, right))
    for i, c in enumerate(names):
        kinds = [{kind(r[i]) for r in side} - {None} for side in (left, right)]
        if kinds[0] and kinds[1] and kinds[0] != kinds[1]:
            return f"type of {c} differs: {kinds}", True
    if a != b:
        x, y = sorted((a - b).items(), key=str)[:3], sorted((b - a).items(), key=str)[:3]
        return f"{len(left)}/{len(right)} rows, {sum((a - b).values())} differ\n   columns {names}\n   spark {x}\n   sql   {y}", True
    return f"ok {len(left)}", len(left) == 0


def main(patterns, sf="0.01"):
    import __spark_entry__ as entry
    from cytomosaic.session import local_session

    spark = local_session(8)
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    plans, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, plan in plans.items():
        if patterns and not any(p in name for p in patterns):
            continue
        start = time.time()
        try:
            message, failed = compare(spark, con, plan, oracle.get(name), sf_dir)
        except Exception as err:  # report and go on with the next query
            message, failed = f"{type(err).__name__}: {str(err)[:1200]}", True
        bad += failed
        print(f"{'FAIL' if failed else 'pass'} {name} {time.time() - start:.1f}s {message}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = next((a[3:] for a in args if a.startswith("sf=")), "0.01")
    sys.exit(1 if main([a for a in args if not a.startswith("sf=")], sf) else 0)
