"""Runs a registered query on Spark and its SQL on DuckDB and compares the results."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, int):
        return repr(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(norm(x)) for x in v) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple("" if x is None else str(x) for x in r))


def compare(spark, con, folder, fn, sql):
    """(ok, message, spark seconds, duckdb seconds, rows)"""
    t0 = time.time()
    df = fn(spark, folder)
    got = df.collect()
    t1 = time.time()
    gc, gr = rows_of(df.columns, got)
    types = dict(df.dtypes)
    if sql is None:
        return True, f"rows only: {len(gr)}", t1 - t0, 0.0, len(gr)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    dtypes = {x[0]: str(x[1]) for x in cur.description}
    exp = cur.fetchall()
    t2 = time.time()
    ec, er = rows_of(names, exp)
    if gc != ec:
        return False, f"columns {gc} != {ec}", t1 - t0, t2 - t1, len(gr)
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    bad = {c: (types[c], dtypes[c]) for c in types if kinds.get(dtypes[c], types[c]) != types[c] or dtypes[c] == "HUGEINT"}
    if gr != er:
        diff = [(a, b) for a, b in zip(gr, er) if a != b][:3]
        return False, f"rows {len(gr)} vs {len(er)}; first differences {diff}", t1 - t0, t2 - t1, len(gr)
    if bad:
        return False, f"types {bad}", t1 - t0, t2 - t1, len(gr)
    return True, "", t1 - t0, t2 - t1, len(gr)


def main(argv):
    import __spark_entry__ as entry
    from loomgraph.session import local_session

    folder = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = argv[2:]
    spark, con = local_session("8"), duck(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in queries:
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        try:
            ok, msg, a, b, n = compare(spark, con, folder, queries[name], sql.get(name))
        except Exception as e:  # noqa: BLE001
            ok, msg, a, b, n = False, f"{type(e).__name__}: {str(e)[:900]}", 0, 0, 0
        failed += not ok
        empty = "" if n else " EMPTY"
        print(f"{'ok  ' if ok else 'FAIL'} {name:26s} rows={n:<7d} spark={a:.2f}s duck={b:.2f}s{empty} {msg}", flush=True)
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    sys.path.insert(0, ".")
    main(sys.argv)
