"""Compare a query's rows with those of its SQL in DuckDB."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return str([_norm(x) for x in v])
    return str(v)


def same_rows(df, con, sql):
    columns = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in columns) for r in df.collect())
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = sorted(tuple(_norm(row[names.index(c)]) for c in columns) for row in rel.fetchall())
    assert got == want
