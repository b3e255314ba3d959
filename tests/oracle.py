"""Rows of a query and of its SQL, in a form that can be compared."""

import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v)


def rows(table, columns):
    return sorted(tuple(map(plain, r)) for r in table)


def same(df, con, sql):
    result = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(result.columns)
    at = [result.columns.index(c) for c in columns]
    expected = rows(([r[i] for i in at] for r in result.fetchall()), columns)
    found = rows((tuple(r) for r in df.select(*columns).collect()), columns)
    assert found == expected
