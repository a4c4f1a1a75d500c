"""Queries with SQL over keys beyond two bytes of an address, which tables of more rows have."""

import os

import duckdb
import pytest

from packetloom.plans import registry

SF = "/root/testdata/sf0.001"
USERS = ["arp_counts", "arp_findings", "arp_rebinds", "capture_decode", "capture_hosts", "decode_shapes", "dnp3_blocked", "dnp3_counts", "dnp3_findings", "dnp3_malformed", "enip_counts", "enip_findings", "enip_malformed", "flow_close_reasons", "flow_keys", "flow_instances", "reassembled_bytes"]
ORDERS = ["reassembly_first_bytes", "reassembly_conflicts", "small_segment_findings"]
SHIFTED = {
    "events": "CASE WHEN user_id % 3 = 0 THEN user_id WHEN user_id % 3 = 1 THEN user_id * 16 + 65530 ELSE user_id + 100000000 END::BIGINT AS user_id",
    "lineitem": "(CASE WHEN l_orderkey % 2 = 0 THEN l_orderkey ELSE l_orderkey + 16777216 * 3 END)::BIGINT AS l_orderkey",
}


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("large")
    for name in os.listdir(SF):
        table = name[:-8]
        if table in SHIFTED:
            duckdb.connect().execute(f"COPY (SELECT * REPLACE ({SHIFTED[table]}) FROM '{SF}/{name}') TO '{folder}/{name}' (FORMAT parquet)")
        else:
            (folder / name).symlink_to(f"{SF}/{name}")
    return str(folder)


@pytest.mark.parametrize("name", USERS + ORDERS)
def test_large_keys_match_sql(spark, tables, name):
    con = duckdb.connect()
    for table in ("events", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tables}/{table}.parquet')")
    df = registry.QUERIES[name](spark, tables)
    columns = ", ".join(sorted(df.columns))
    con.register("got_view", df.toPandas())
    con.execute(f"CREATE TABLE got AS SELECT {columns} FROM got_view")
    con.execute(f"CREATE TABLE want AS SELECT {columns} FROM ({registry.ORACLE_SQL[name]})")
    both = con.execute("SELECT (SELECT count(*) FROM (SELECT * FROM want EXCEPT ALL SELECT * FROM got)), (SELECT count(*) FROM (SELECT * FROM got EXCEPT ALL SELECT * FROM want)), (SELECT count(*) FROM want)").fetchall()[0]
    assert both[:2] == (0, 0) and both[2] > 0


def test_tables_of_more_rows_are_dealt_to_more_tasks(spark, monkeypatch):
    from packetloom.plans import virtual

    monkeypatch.setattr(virtual, "ROWS", 100)
    assert virtual.dealt(spark.range(5000), "id").rdd.getNumPartitions() == 50
    assert virtual.dealt(spark.range(50), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
