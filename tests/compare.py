"""Comparison of a query's rows with those of its SQL in DuckDB."""

import glob
import os

import duckdb

FOLDER = "/root/testdata/sf0.001"


def connection(folder=FOLDER):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    return v if isinstance(v, (int, str, type(None))) else str(v)


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_of_sql(con, sql):
    done = con.execute(sql)
    names = [x[0] for x in done.description]
    cols = sorted(names)
    return cols, sorted((tuple(_plain(r[names.index(c)]) for c in cols) for r in done.fetchall()), key=repr)
