"""Compares a query's rows with those of its SQL."""

import decimal
import glob
import os

import duckdb


def connection(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if v != v else f"{float(v) + 0.0:.6g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.6g}" if abs(v) < 10**6 else str(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def same(df, con, sql):
    cols = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    out = con.sql(sql)
    assert sorted(out.columns) == cols
    at = [out.columns.index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in at) for r in out.fetchall())
    assert len(got) == len(want)
    assert got == want
