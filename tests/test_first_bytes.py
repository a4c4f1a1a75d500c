"""Modbus queries with SQL over users whose first transaction number looks like the beginning of a TLS record."""

import duckdb
import pytest

from packetloom.plans import registry


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("first")
    # 0x1603 is 5635; every second event has it for its transaction
    marked = "event_id * 65536 + 5635 + event_id % 2 AS event_id"
    duckdb.connect().execute(f"COPY (SELECT * REPLACE ({marked}) FROM '/root/testdata/sf0.001/events.parquet') TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["modbus_counts", "modbus_findings", "modbus_function_codes", "modbus_units"])
def test_streams_that_begin_like_tls_match_sql(spark, tables, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tables}/events.parquet')")
    df = registry.QUERIES[name](spark, tables)
    columns = ", ".join(sorted(df.columns))
    con.register("got_view", df.toPandas())
    con.execute(f"CREATE TABLE got AS SELECT {columns} FROM got_view")
    con.execute(f"CREATE TABLE want AS SELECT {columns} FROM ({registry.ORACLE_SQL[name]})")
    both = con.execute("SELECT (SELECT count(*) FROM (SELECT * FROM want EXCEPT ALL SELECT * FROM got)), (SELECT count(*) FROM (SELECT * FROM got EXCEPT ALL SELECT * FROM want)), (SELECT count(*) FROM want)").fetchall()[0]
    assert both[:2] == (0, 0) and both[2] > 0
