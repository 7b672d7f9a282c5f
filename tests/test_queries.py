"""Every query with a DuckDB twin gives the same rows, values and columns."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("orders", "lineitem", "events", "embeddings", "documents", "pages", "benchmark", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)

    def rows(df):
        return df[cols].sort_values(cols).reset_index(drop=True).fillna(-9)

    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for c in cols:
        assert (a[c] == b[c]).all(), c
