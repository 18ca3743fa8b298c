"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from folioscan import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", list(catalog.ORACLE))
def test_query_equals_sql(spark, duck, tmp_path, name):
    catalog.QUERIES[name](spark, SF).write.parquet(str(tmp_path / "got"))
    want = duck.sql(catalog.ORACLE[name])
    got = duck.sql(f"SELECT * FROM '{tmp_path}/got/*.parquet'")
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert dict(zip(got.columns, map(str, got.types))) == dict(zip(want.columns, map(str, want.types)))
    pick = ", ".join(f'"{c}"' for c in columns)
    got, want = duck.sql(f"SELECT {pick} FROM got"), duck.sql(f"SELECT {pick} FROM want")
    assert not duck.sql("FROM got EXCEPT ALL FROM want").fetchall()
    assert not duck.sql("FROM want EXCEPT ALL FROM got").fetchall()


def test_entry_has_rows(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["unique_id", "json"] and rows.count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
