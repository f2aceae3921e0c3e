"""Spark results against DuckDB's, row for row."""

import datetime
import os

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder=SF):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def oracle_rows(con, sql):
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    cols = sorted(names)
    return cols, sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
