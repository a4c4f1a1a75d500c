"""What the passes over packets cost: frames built once, values of batches without scalar objects."""

import pyarrow as pa
from pyspark.sql import functions as F

from packetloom.operators import decode
from packetloom.operators.ordered import _dicts
from packetloom.plans import stream_queries, virtual


def test_a_frame_is_built_once(spark):
    rows = spark.range(20).where("id > 1")
    frame = virtual.ipv4_frame(6, virtual.client(F.col("id")), F.lit("c0a80001"), virtual.tcp_body(F.lit(1), F.lit(2), F.col("id"), F.lit(16), F.lit("61")))
    packets = decode.packets(virtual.raw(rows, F.col("id"), F.col("id"), frame))
    assert packets._jdf.queryExecution().executedPlan().toString().count("unhex(") == 1
    assert packets.where("protocol = 'Tcp' AND payload = X'61'").count() == 18


def test_methods_of_the_decoder_stay_small(spark):
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    decode.packets(virtual.raw(spark.range(1), F.col("id"), F.col("id"), F.lit("00")))
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_lines_are_read_once(spark):
    packets = stream_queries.line_packets(spark, "/root/testdata/sf0.001")
    assert "lineitem" not in packets._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in packets._jdf.queryExecution().optimizedPlan().toString()


def test_values_of_batches():
    columns = {
        "a": pa.array([1, None, 3], pa.int64()), "b": pa.array([1, 2, 3], pa.int32()), "c": pa.array([True, False, True]), "d": pa.array([True, None, False]), "e": pa.array(["x", None, ""]),
        "f": pa.array([b"", None, b"\x00\xff"], pa.binary()), "g": pa.array([[1], None, []], pa.list_(pa.int32())), "h": pa.array([1.5, None, 2.0]),
    }
    batch = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    assert list(_dicts(batch)) == batch.to_pylist() and list(_dicts(batch.slice(1, 1))) == batch.slice(1, 1).to_pylist()
    assert [type(x) for row in _dicts(batch) for x in row.values()] == [type(x) for row in batch.to_pylist() for x in row.values()]
