"""Compare registered Spark queries with their DuckDB oracle SQL.

Run as a script: ``python tests/oracle_compare.py [sf_dir] [name ...]``.
The comparison mirrors the driver: same row count, same column names, and
the same multiset of rows (columns sorted by name, values stringified).
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
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return repr(v)  # exact: both sides round to 6 decimals; -0.0 and 0.0 stay distinct
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    vals = sorted(tuple(_norm(r[i]) for i in order) for r in rows)
    return cols, vals


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT", "date": "DATE"}


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    rel = con.sql(sql)
    drows = rel.fetchall()
    scols, svals = canonical(sdf.columns, srows)
    dcols, dvals = canonical(rel.columns, drows)
    stypes = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
              for f in sdf.schema.fields}
    dtypes = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    types_ok = all(stypes.get(c) == dtypes.get(c) for c in dtypes) or scols != dcols
    ok = scols == dcols and svals == dvals and types_ok
    detail = ""
    if not types_ok:
        detail = "types " + str({c: (stypes.get(c), dtypes.get(c)) for c in dtypes
                                 if stypes.get(c) != dtypes.get(c)})
    if scols != dcols:
        detail = f"cols spark={scols} duck={dcols}"
    elif len(svals) != len(dvals):
        detail = f"rows spark={len(svals)} duck={len(dvals)}"
    elif svals != dvals:
        diff = [(a, b) for a, b in zip(svals, dvals) if a != b][:3]
        detail = f"values differ, e.g. {diff}"
    return ok, len(srows), t1 - t0, detail


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from basketry.session import local_session
    import __spark_entry__ as entry
    spark = local_session(8, 8)
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(qs):
        if name not in sqls:
            t0 = time.time()
            n = qs[name](spark, sf_dir).count()
            print(f"{'ROWS':5} {name:34} rows={n:7d} {time.time()-t0:6.2f}s (no oracle)", flush=True)
            continue
        try:
            ok, n, sec, detail = compare(spark, con, sf_dir, name, qs[name], sqls[name])
        except Exception as exc:  # report and continue
            ok, n, sec, detail = False, -1, 0.0, f"{type(exc).__name__}: {str(exc)[:300]}"
        bad += not ok
        print(f"{'OK' if ok else 'FAIL':5} {name:34} rows={n:7d} {sec:6.2f}s {detail}", flush=True)
    print(f"mismatches: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
