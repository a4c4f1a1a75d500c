"""Queries with SQL over keys beyond the addresses and sequence numbers of four bytes."""

import duckdb
import pytest

from packetloom.plans import registry, virtual

NAMES = ["arp_findings", "arp_rebinds", "capture_decode", "capture_hosts", "decode_shapes", "dnp3_blocked", "dnp3_counts", "dnp3_findings", "dnp3_malformed", "enip_counts", "enip_findings", "enip_malformed", "flow_keys"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("far")
    keys = "event_id + event_id % 3 * 10000000000 AS event_id, (user_id % 5 * 1000000000 + user_id)::BIGINT AS user_id"
    duckdb.connect().execute(f"COPY (SELECT * REPLACE ({keys}) FROM '/root/testdata/sf0.001/events.parquet') TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_far_keys_match_sql(spark, tables, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tables}/events.parquet')")
    df = registry.QUERIES[name](spark, tables)
    columns = ", ".join(sorted(df.columns))
    con.register("got_view", df.toPandas())
    con.execute(f"CREATE TABLE got AS SELECT {columns} FROM got_view")
    con.execute(f"CREATE TABLE want AS SELECT {columns} FROM ({registry.ORACLE_SQL[name]})")
    both = con.execute("SELECT (SELECT count(*) FROM (SELECT * FROM want EXCEPT ALL SELECT * FROM got)), (SELECT count(*) FROM (SELECT * FROM got EXCEPT ALL SELECT * FROM want)), (SELECT count(*) FROM want)").fetchall()[0]
    assert both[:2] == (0, 0) and both[2] > 0


def test_ranks_follow_the_users_order(spark, tables):
    ranks = [tuple(r) for r in virtual.users(spark, tables).orderBy("user_id").collect()]
    assert [n for _, n in ranks] == list(range(len(ranks))) and len(ranks) == len({u for u, _ in ranks}) > 5
    assert virtual.users(spark, "/root/testdata/sf0.001") is None
