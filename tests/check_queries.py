"""Compare registered queries with their DuckDB text: python tests/check_queries.py [sf] [name-part ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.9g}"
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), sorted(cols)


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    s_rows, s_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"{len(s_rows)} rows, no SQL"
    cur = con.execute(sql)
    d_cols = [x[0] for x in cur.description]
    d_rows, d_cols = rows_of(d_cols, cur.fetchall())
    if s_cols != d_cols:
        return False, f"columns {s_cols} vs {d_cols}"
    if len(s_rows) != len(d_rows):
        return False, f"rows {len(s_rows)} vs {len(d_rows)}"
    bad = [(a, b) for a, b in zip(s_rows, d_rows) if a != b]
    if bad:
        return False, f"{len(bad)} of {len(s_rows)} rows differ, e.g.\n   spark {bad[0][0]}\n   duck  {bad[0][1]}"
    return True, f"{len(s_rows)} rows"


if __name__ == "__main__":
    import __spark_entry__ as e
    from tapegrain.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    spark = build_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    sqls = e.oracle_sql()
    n = bad = 0
    for name, fn in e.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            ok, msg = compare(spark, con, sf_dir, fn, sqls.get(name))
        except Exception as ex:  # noqa: BLE001
            ok, msg = False, f"{type(ex).__name__}: {str(ex)[:900]}"
        n += 1
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {msg}", flush=True)
    print(f"{n} checked, {bad} failed")
