"""Queries with SQL over users whose events lie more packets apart than the flow table keeps an idle flow."""

import duckdb
import pytest

from packetloom.plans import registry

#: More than the 65,536 packets of an idle flow and the 8,192 between two sweeps.
BETWEEN = 80_000


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("apart")
    far = "event_id % 1000 + event_id // 500 * 200000 AS event_id, (event_id % 7)::BIGINT AS user_id"
    con = duckdb.connect()
    con.execute(f"CREATE TABLE e AS SELECT * REPLACE ({far}) FROM '/root/testdata/sf0.001/events.parquet'")
    # each of the users that lie between has one event; the first of the others' second parts comes from the server
    con.execute("UPDATE e SET event_type = 'error' WHERE event_id BETWEEN 200000 AND 200600")
    con.execute(f"INSERT INTO e SELECT 10000 + i, TIMESTAMP '2024-01-01', 100 + i, 'view', 1, '' FROM range({BETWEEN}) r(i)")
    con.execute(f"COPY (SELECT * FROM e ORDER BY event_id) TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["dnp3_findings", "enip_findings", "modbus_pairs"])
def test_events_far_apart_match_sql(spark, tables, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tables}/events.parquet')")
    df = registry.QUERIES[name](spark, tables)
    columns = ", ".join(sorted(df.columns))
    con.register("got_view", df.toPandas())
    con.execute(f"CREATE TABLE got AS SELECT {columns} FROM got_view")
    con.execute(f"CREATE TABLE want AS SELECT {columns} FROM ({registry.ORACLE_SQL[name]})")
    both = con.execute("SELECT (SELECT count(*) FROM (SELECT * FROM want EXCEPT ALL SELECT * FROM got)), (SELECT count(*) FROM (SELECT * FROM got EXCEPT ALL SELECT * FROM want)), (SELECT count(*) FROM want)").fetchall()[0]
    assert both[:2] == (0, 0) and both[2] > 0
