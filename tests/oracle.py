"""Comparison of a query with its SQL on DuckDB."""

from __future__ import annotations

import math
import os

import duckdb
import numpy as np


def plain(v):
    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, float):
        return round(v, 9) if math.isfinite(v) else repr(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    return v


def same_rows(spark, d, query, sql):
    c = duckdb.connect()
    for f in os.listdir(d):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{d}/{f}'")
    df = query(spark, d)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[k]) for k in names) for r in df.collect()), key=repr)
    quoted = ", ".join(f'"{k}"' for k in names)
    want = sorted((tuple(map(plain, r)) for r in c.sql(f"SELECT {quoted} FROM ({sql})").fetchall()), key=repr)
    assert sorted(c.sql(sql).columns) == names
    assert got == want
