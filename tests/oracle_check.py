"""Run registered queries and their DuckDB twins side by side: ``python tests/oracle_check.py [sf] [keys]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _cell(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    key = lambda r: tuple((x is None, round(x, 3) if isinstance(x, float) else x) if not isinstance(x, (bool,)) else (False, x) for x in r)
    got = [tuple(_cell(r[i]) for i in order) for r in rows]
    try:
        return sorted(got, key=key)
    except TypeError:
        return sorted(got, key=lambda r: tuple(str(x) for x in key(r)))


def _same(a, b, tol):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return a == b if tol is None else math.isclose(a, b, rel_tol=tol, abs_tol=tol)
    return a == b


def compare(spark, con, key, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return f"rows-only {len(got)}", took, True
    rel = con.sql(sql)
    want = rel.fetchall()
    if sorted(df.columns) != sorted(rel.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(rel.columns)}", took, False
    a, b = _rows(df.columns, got), _rows(rel.columns, want)
    if len(a) != len(b):
        return f"ROWS {len(a)} vs {len(b)}", took, False
    types = {c: (str(df.schema[c].dataType.simpleString()), str(t)) for c, t in zip(rel.columns, rel.types)}
    odd = {c: t for c, t in types.items() if t[1] in ("HUGEINT",) or t[1].startswith("DECIMAL") != t[0].startswith("decimal")}
    for tol in (None, 1e-9, 1e-6):
        bad = [(x, y) for x, y in zip(a, b) if not all(_same(p, q, tol) for p, q in zip(x, y))]
        if not bad:
            return f"ok {len(a)} rows" + (f" (tol {tol})" if tol else "") + (f" types {odd}" if odd else ""), took, tol is None and not odd
    return f"VALUES {len(bad)}/{len(a)}: {sorted(df.columns)}\n   {bad[0][0]}\n   {bad[0][1]}", took, False


def main(sf="0.01", keys=()):
    import duckdb
    import __spark_entry__ as entry
    from cashtrail.session import local_session
    spark = local_session()
    sf_dir = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    q, s = entry.queries(), entry.oracle_sql()
    bad = 0
    for k in (keys or q):
        try:
            msg, took, ok = compare(spark, con, k, q[k], s.get(k), sf_dir)
        except Exception as e:  # report and go on with the next query
            msg, took, ok = f"ERROR {str(e)[:1500]}", 0, False
        bad += not ok
        print(f"{'  ' if ok else '!!'} {k:14s} {took:6.2f}s {msg}", flush=True)
    print("not exact:", bad)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "0.01", sys.argv[2].split(",") if len(sys.argv) > 2 else ())
