"""Runs a query and its SQL over the same tables and compares columns, row count and values."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def check(spark, name, query, sql, sf=SF):
    df = query(spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr(plain(tuple(r))) for r in df.select(*cols).collect())
    con = connect(sf)
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    assert sorted(names) == cols, name
    at = [names.index(c) for c in cols]
    want = sorted(repr(plain(tuple(r[i] for i in at))) for r in done.fetchall())
    assert got == want, name
