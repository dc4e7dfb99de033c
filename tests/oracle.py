"""Compares a query with DuckDB on the same tables."""

import decimal
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(found, columns, order):
    return sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in found), key=lambda r: [(x is None, str(x)) for x in r])


def same(query, sql, spark, data):
    df = query(spark, data)
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for p in Path(data).iterdir():
        con.sql(f"create view {p.stem} as select * from '{p}'")
    rel = con.sql(sql)
    order = sorted(df.columns)
    assert order == sorted(rel.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns, order) == rows(rel.fetchall(), list(rel.columns), order)
