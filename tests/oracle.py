"""Runs a query's SQL in DuckDB and compares rows as multisets."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def same(df, sql: str, d: str) -> None:
    rel = duck(d).sql(sql)
    names = sorted(rel.columns)
    assert sorted(df.columns) == names
    want = sorted((repr([plain(r[rel.columns.index(n)]) for n in names]) for r in rel.fetchall()))
    got = sorted(repr([plain(r[n]) for n in names]) for r in df.collect())
    assert len(got) == len(want), (len(got), len(want))
    assert got == want, next((g, w) for g, w in zip(got, want) if g != w)
