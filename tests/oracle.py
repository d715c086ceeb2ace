"""Rows of a query and of its SQL in one form."""

from __future__ import annotations

import math
import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(folder):
        con.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 9)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def rows_of(df) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)


def rows_of_sql(con, sql: str, columns: list[str]) -> list[tuple]:
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(columns)
    at = [names.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
