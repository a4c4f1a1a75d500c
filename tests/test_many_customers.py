"""TLS queries with SQL over more customers than a report's counter has keys, and suites of the form of reserved values."""

import duckdb
import pytest

from packetloom.operators import http
from packetloom.plans import registry

CUSTOMERS = http.MOST_KEYS + 100


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("many")
    duckdb.connect().execute(f"COPY (SELECT range AS c_custkey FROM range({CUSTOMERS})) TO '{folder}/customer.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["tls_counts", "tls_hello_fingerprints"])
def test_many_customers_match_sql(spark, tables, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tables}/customer.parquet')")
    df = registry.QUERIES[name](spark, tables)
    columns = ", ".join(sorted(df.columns))
    con.register("got_view", df.toPandas())
    con.execute(f"CREATE TABLE got AS SELECT {columns} FROM got_view")
    con.execute(f"CREATE TABLE want AS SELECT {columns} FROM ({registry.ORACLE_SQL[name]})")
    both = con.execute("SELECT (SELECT count(*) FROM (SELECT * FROM want EXCEPT ALL SELECT * FROM got)), (SELECT count(*) FROM (SELECT * FROM got EXCEPT ALL SELECT * FROM want)), (SELECT count(*) FROM want)").fetchall()[0]
    assert both[:2] == (0, 0) and both[2] > 0
