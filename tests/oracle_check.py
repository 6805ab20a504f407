"""Run registered queries and their DuckDB oracle side by side.

    python tests/oracle_check.py [sf_dir] [name ...]

Prints one line per query: rows, column match, value match, seconds.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "as_integer_ratio") and not isinstance(v, int):  # Decimal
        return round(float(v), 6)
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return ([cols[i] for i in order],
            sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr))


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def compare(spark, name, fn, sql, con, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    ts = time.time() - t
    sc, sv = canon(df.columns, rows)
    if sql is None:
        return dict(name=name, rows=len(rows), oracle=None, spark_s=ts)
    t = time.time()
    rel = con.sql(sql)
    ocols = rel.columns
    orows = rel.fetchall()
    td = time.time() - t
    oc, ov = canon(ocols, orows)
    return dict(name=name, rows=len(rows), orows=len(orows), cols=sc == oc, values=sv == ov,
                spark_s=round(ts, 2), duck_s=round(td, 2),
                diff=None if sv == ov else [x for x in sv if x not in ov][:3] + ["|"] + [x for x in ov if x not in sv][:3])


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from dendrospark.session import local_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = local_session("local[8]", 8)
    con = duck(sf_dir)
    qs, sq = queries(), oracle_sql()
    bad = 0
    for name in (names or list(qs)):
        try:
            r = compare(spark, name, qs[name], sq.get(name), con, sf_dir)
        except Exception as e:  # report and go on
            r = dict(name=name, error=repr(e)[:400])
        ok = r.get("oracle", True) is None or (r.get("cols") and r.get("values") and r.get("rows") == r.get("orows"))
        bad += 0 if ok and "error" not in r else 1
        print(("OK  " if ok and "error" not in r else "BAD ") + str(r), flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
