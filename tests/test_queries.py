"""Every registered query of the library against its DuckDB oracle."""

import duckdb
import pytest

from paperloom import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for name in ("documents", "conversations", "benchmark", "labels", "pages", "events"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_oracle(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    found = con.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    want = sorted(repr(tuple(r[found.columns.index(c)] for c in columns)) for r in found.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want
