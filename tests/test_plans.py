import os

import duckdb
import pytest

from loomspark.plans import delivery, pipeline
from tools_compare import TABLES, rows_of

SQL = delivery.SQL | pipeline.SQL
QUERIES = delivery.QUERIES | pipeline.QUERIES


@pytest.fixture(scope="module")
def duck(small):
    if not os.path.isdir(small):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(SQL[name])
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, res.fetchall())


def test_every_query_has_a_name_of_its_own():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert not set(delivery.QUERIES) & set(pipeline.QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_run(spark, small, name):
    if not os.path.isdir(small):
        pytest.skip("no test tables")
    assert QUERIES[name](spark, small).count() >= 0
