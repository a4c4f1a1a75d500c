"""Every query with SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from packetloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    columns = ", ".join(sorted(df.columns))
    con.register("got_view", df.toPandas())
    con.execute(f"CREATE OR REPLACE TABLE got AS SELECT {columns} FROM got_view")
    con.execute(f"CREATE OR REPLACE TABLE want AS SELECT {columns} FROM ({registry.ORACLE_SQL[name]})")
    both = con.execute("SELECT (SELECT count(*) FROM (SELECT * FROM want EXCEPT ALL SELECT * FROM got)), (SELECT count(*) FROM (SELECT * FROM got EXCEPT ALL SELECT * FROM want)), (SELECT count(*) FROM want)").fetchall()[0]
    assert both[:2] == (0, 0) and both[2] > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
