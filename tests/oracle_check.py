"""Run registered queries in Spark and their oracle SQL in DuckDB; compare
row count, column names and an order-insensitive value hash.

usage: python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return f"{round(v, 6):.6f}"
    if isinstance(v, (bytes, bytearray)):
        return v.hex()
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, bool):
        return str(v).lower()
    if hasattr(v, "__float__") and not isinstance(v, int):
        return f"{round(float(v), 6):.6f}"
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def main(argv):
    sf_dir = "/root/testdata/sf0.01"
    names = []
    for a in argv:
        if a.startswith("/"):
            sf_dir = a
        else:
            names.append(a)
    import duckdb
    import __spark_entry__ as E
    from mdloom.session import local_session
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    qs, oracle = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            cols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"{name:24s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in oracle:
            print(f"{name:24s} rows={len(rows):7d} (no oracle) {ts:.1f}s")
            continue
        try:
            rel = con.sql(oracle[name])
            orows = rel.fetchall()
            ocols = rel.columns
        except Exception as e:  # noqa: BLE001
            print(f"{name:24s} ORACLE-ERROR {str(e)[:300]}")
            bad += 1
            continue
        h1, l1 = digest(cols, rows)
        h2, l2 = digest(ocols, orows)
        ok = sorted(cols) == sorted(ocols) and len(rows) == len(orows) and h1 == h2
        print(f"{name:24s} {'OK  ' if ok else 'DIFF'} rows={len(rows)}/{len(orows)} {ts:.1f}s"
              + ("" if sorted(cols) == sorted(ocols) else f" cols {sorted(cols)} vs {sorted(ocols)}"))
        if not ok:
            bad += 1
            s1, s2 = set(l1), set(l2)
            for x in sorted(s1 - s2)[:3]:
                print("   spark :", repr(x[:600]))
            for x in sorted(s2 - s1)[:3]:
                print("   oracle:", repr(x[:600]))
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
