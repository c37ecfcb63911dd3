"""Comparison of a query with its SQL on DuckDB."""

import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def same(df, con, sql):
    columns = sorted(df.columns)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    ours = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    theirs = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())
    assert ours == theirs
