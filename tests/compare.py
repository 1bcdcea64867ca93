"""Runs a query and its SQL on the same tables and compares rows."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v




def differences(spark, query, sql: str, folder: str) -> str:
    """Empty if both give the same rows."""
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    cur = con.execute(sql)
    want_names = [c[0] for c in cur.description]
    want = cur.fetchall()
    df = query(spark, folder)
    got = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(want_names):
        return f"columns {df.columns} and {want_names}"
    key = lambda r: tuple(map(str, r))
    order = lambda names, v: sorted((tuple(plain(r[k]) for k in sorted(range(len(names)), key=lambda k: names[k])) for r in v), key=key)
    a, b = order(df.columns, got), order(want_names, want)
    if a != b:
        odd = next(((x, y) for x, y in zip(a, b) if x != y), ("length", (len(a), len(b))))
        return f"{len(a)} and {len(b)} rows; first difference {str(odd)[:400]}"
    return ""
