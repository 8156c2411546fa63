"""Comparison of a query with its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pandas as pd

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(v, 9) if isinstance(v, float) else v


def rows(df):
    names = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def expected(sql, sf=SF, views=None):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    for name, frame in (views or {}).items():
        con.register(f"_{name}", frame)
        con.execute(f"create or replace view {name} as select * from _{name}")
    got = con.execute(sql).df()
    names = sorted(got.columns)
    return sorted((tuple(plain(v) for v in r) for r in got[names].itertuples(index=False)), key=repr)


def same(df, sql, sf=SF, views=None):
    assert rows(df) == expected(sql, sf, views)
