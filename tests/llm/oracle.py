"""Runs a DuckDB oracle over small pandas tables and compares it with Spark rows."""

import duckdb


def same_rows(df, sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    found = con.sql(sql)
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    want = sorted(repr(tuple(row[found.columns.index(c)] for c in columns)) for row in found.fetchall())
    got = sorted(repr(tuple(row[c] for c in columns)) for row in df.collect())
    assert got == want
