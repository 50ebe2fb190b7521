"""Comparison of a query's rows with those of its SQL in DuckDB."""

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple(plain(r[k]) for k in at) for r in rows), key=lambda r: tuple((x is not None, float(x) if isinstance(x, (int, float)) else 0.0, str(x)) for x in r))


def same(df, con, text):
    columns = sorted(df.columns)
    found = con.execute(text)
    theirs = [c[0] for c in found.description]
    assert sorted(theirs) == columns
    got = rows_of(df.columns, df.collect(), columns)
    want = rows_of(theirs, found.fetchall(), columns)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == w
