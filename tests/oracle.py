"""Holds a Spark result against DuckDB's answer on the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def same(df, sql: str, folder: str = SMALL, views: dict | None = None) -> None:
    con = duckdb.connect()
    for t in TABLES:
        path = (views or {}).get(t, f"{folder}/{t}.parquet")
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    r = con.sql(sql)
    names = list(r.columns)
    columns = sorted(df.columns)
    assert sorted(names) == columns
    want = sorted((tuple(value(x[names.index(c)]) for c in columns) for x in r.fetchall()), key=repr)
    got = sorted((tuple(value(x[c]) for c in columns) for x in df.collect()), key=repr)
    assert got == want
