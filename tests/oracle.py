"""Compare a registered query with its SQL on the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def kind(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    return type(value).__name__


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), [tuple(r[i] for i in order) for r in rows]


def sort_key(row):
    return tuple((v is None, str(type(v)), v if not isinstance(v, float) or not math.isnan(v) else 0.0) for v in row)


def compare(got_columns, got, want_columns, want, tol=0.0):
    """None when equal, else a short text."""
    gc, g = rows_of(got_columns, got)
    wc, w = rows_of(want_columns, want)
    if gc != wc:
        return f"columns {gc} != {wc}"
    if len(g) != len(w):
        return f"rows {len(g)} != {len(w)}"
    g, w = sorted(g, key=sort_key), sorted(w, key=sort_key)
    for a, b in zip(g, w):
        for name, x, y in zip(gc, a, b):
            if kind(x) != kind(y) and x is not None and y is not None:
                return f"type of {name}: {kind(x)} != {kind(y)} ({x!r}, {y!r})"
            if x != y:
                close = isinstance(x, float) and isinstance(y, float) and abs(x - y) <= tol
                if not close:
                    return f"{name}: {x!r} != {y!r} in {a} / {b}"
    return None


def check(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want = cur.fetchall()
    return compare(df.columns, got, [c[0] for c in cur.description], want), len(got)
