"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from __spark_entry__ import FLAGSHIP, oracle_sql, queries
from check_oracle import TABLES, rows

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')")
    return con


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())
    assert FLAGSHIP in queries()


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(name, spark, db):
    df = queries()[name](spark, SF_DIR)
    mine = rows(df.columns, df.collect())
    sql = oracle_sql().get(name)
    if sql is None:
        assert mine
        return
    result = db.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert mine == rows(columns, result.fetchall())
