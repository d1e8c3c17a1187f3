"""Runs registered queries next to their SQL and compares whole results (also usable by hand: ``python tests/compare.py [names]``)."""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (float, Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else (str(int(v)) if v.is_integer() and abs(v) < 1e15 else f"{v:.12g}")
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf):
    """Returns (n_rows, error text or None)."""
    df = query(spark, sf)
    cols, got = rows_of(df.columns, df.collect())
    if sql is None:
        return len(got), None
    res = con.execute(sql)
    ocols, want = rows_of([d[0] for d in res.description], res.fetchall())
    if cols != ocols:
        return len(got), f"columns {cols} != {ocols}"
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return len(got), f"{len(got)} vs {len(want)} rows\n   only spark {sorted(a)[:3]}\n   only sql   {sorted(b)[:3]}"
    return len(got), None


if __name__ == "__main__":
    from wireloom.plans import catalogue
    from wireloom.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
    spark, con = local_session(), connection(sf)
    qs, orc = catalogue.queries(), catalogue.oracle_sql()
    names = [n for n in qs if not sys.argv[1:] or any(n.startswith(a) for a in sys.argv[1:])]
    bad = 0
    for n in names:
        t = time.time()
        try:
            count, err = compare(spark, con, n, qs[n], orc.get(n), sf)
        except Exception as e:  # report and go on
            count, err = -1, f"{type(e).__name__}: {str(e)[:700]}"
        bad += err is not None
        print(f"{'BAD' if err else 'ok '} {n:32s} rows={count} {time.time() - t:.1f}s {'' if n in orc else '(rows only)'} {err or ''}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
