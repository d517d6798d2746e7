import duckdb
import pytest

from stratacell.llm import oracle_sql, queries

from .conftest import SF


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, expected = queries()[name](spark, SF), con.sql(oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(expected.columns) == columns
    order = [expected.columns.index(c) for c in columns]
    assert sorted(map(tuple, df.select(columns).collect()), key=str) == sorted((tuple(r[i] for i in order) for r in expected.fetchall()), key=str)
