"""Rows of Spark and of DuckDB over the same tables, in a comparable form."""

import glob
import os


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6) + 0.0
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x


def rows(found, columns, names):
    at = [names.index(c) for c in columns]
    return sorted((tuple(plain(r[i]) for i in at) for r in found), key=lambda r: tuple((v is None, str(v)) for v in r))


def same(con, df, sql):
    theirs = con.sql(sql)
    columns = sorted(theirs.columns)
    assert sorted(df.columns) == columns
    assert rows(df.collect(), columns, df.columns) == rows(theirs.fetchall(), columns, theirs.columns)
