"""A query's rows beside those of its SQL."""

import glob
import os

import duckdb


def plain(x):
    return round(x, 5) if isinstance(x, float) else x


def both(spark, query, sql, d):
    df = query(spark, d)
    names = sorted(df.columns)
    con = duckdb.connect()
    for f in glob.glob(f"{d}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = con.sql(sql)
    assert sorted(got.columns) == names
    at = [got.columns.index(c) for c in names]
    return sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr), sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)
