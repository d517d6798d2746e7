import math

import duckdb
import pytest

from stratacell.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(rows):
    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
        return repr(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = db.sql(ORACLE[name])
    assert sorted(expected.columns) == columns
    order = [expected.columns.index(c) for c in columns]
    want = normal(tuple(r[i] for i in order) for r in expected.fetchall())
    got = normal(tuple(r) for r in df.select(columns).collect())
    assert len(got) == len(want) and got == want
    assert want
