"""Runs registered queries next to their SQL and reports rows, time and differences.

    python tests/verify.py [-s SF_DIR] [NAME_PART ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def compare(got_cols, got, want_cols, want) -> str:
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    order_g = [got_cols.index(c) for c in sorted(got_cols)]
    order_w = [want_cols.index(c) for c in sorted(want_cols)]
    a = sorted([tuple(canon(r[i]) for i in order_g) for r in got], key=key)
    b = sorted([tuple(canon(r[i]) for i in order_w) for r in want], key=key)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first:\n   {sorted(got_cols)}\n   spark {bad[0][0]}\n   sql   {bad[0][1]}"
    return ""


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("-s", default="/root/testdata/sf0.01")
    ap.add_argument("-x", action="store_true", help="stop at the first failure")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    import __spark_entry__ as entry
    from panelwright.session import local_session

    spark = local_session("8")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'") if False else None
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{a.s}/{t}.parquet'")
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sorted(queries):
        if a.names and not any(n == name or n in name for n in a.names):
            continue
        t0 = time.time()
        try:
            df = queries[name](spark, a.s)
            got = [tuple(r) for r in df.collect()]
        except Exception as e:  # report and go on
            bad += 1
            print(f"ERROR {name}: {str(e)[:900]}", flush=True)
            continue
        t1 = time.time()
        if name not in oracles:
            print(f"rows  {name}: {len(got)} rows, {t1 - t0:.1f}s (no SQL)", flush=True)
            continue
        try:
            rel = con.execute(oracles[name])
            cols = [d[0] for d in rel.description]
            want = rel.fetchall()
        except Exception as e:
            bad += 1
            print(f"ERROR {name} SQL: {str(e)[:900]}", flush=True)
            continue
        diff = compare(df.columns, got, cols, want)
        bad += bool(diff)
        empty = " EMPTY" if not got else ""
        print(f"{'FAIL ' if diff else 'ok   '} {name}: {len(got)} rows{empty}, spark {t1 - t0:.1f}s, sql {time.time() - t1:.1f}s {diff}", flush=True)
        if diff and a.x:
            break
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
