import os

import duckdb
import pytest

from loomspark.llm import plans
from tools_compare import TABLES, rows_of


@pytest.fixture(scope="module")
def duck(small):
    if not os.path.isdir(small):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_as_sql(spark, small, duck, name):
    df = plans.QUERIES[name](spark, small)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(plans.SQL[name])
    assert got == rows_of([d[0] for d in res.description], res.fetchall())


@pytest.mark.parametrize(
    "name, columns",
    [("p2_found", {"message_id", "kind", "start_at"}), ("p2_redacted", {"id", "body", "ingested_at"}), ("p3_found", {"message_id", "first_id"}), ("p8_ids", {"doc_id", "ids"})],
)
def test_columns(spark, small, name, columns):
    if not os.path.isdir(small):
        pytest.skip("no test tables")
    df = plans.QUERIES[name](spark, small)
    assert set(df.columns) == columns and df.count() > 0
