"""Streaming forms against the batch operators."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from packetloom.operators.anchored import anchored_windows
from packetloom.streaming import stateful


def stream(spark, tmp_path, rows, schema, parts, name):
    folder = tmp_path / name
    for i in range(parts):
        spark.createDataFrame(rows[i * len(rows) // parts : (i + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drain(spark, df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_anchored_windows(spark, tmp_path):
    rng = random.Random(1)
    rows, t = [], 0
    for i in range(300):
        t += rng.choice([0, 1, 2, 5, -2])
        rows.append((rng.randrange(4), i, t))
    schema = "k int, n long, t long"
    made = stream(spark, tmp_path, rows, schema, 4, "w").withColumn("event_time", F.timestamp_seconds("t"))
    live = drain(spark, stateful.anchored_windows(made, ["k"], "n", "t", 10, lateness="1 hour"), tmp_path, "windows")
    batch = anchored_windows(spark.createDataFrame(rows, schema), ["k"], ["n"], "t", 10)
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect()))
    assert stateful.alerts(live, 3).count() == batch.where("win_count = 4").count() > 0


def test_flow_sessions(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [("a", 0, at(0), False, False), ("a", 1, at(5), True, False), ("b", 2, at(6), False, False), ("a", 3, at(7), True, False), ("c", 4, at(8), False, True), ("a", 5, at(9), False, False), ("d", 6, at(1000), False, False), ("d", 7, at(3000), False, False), ("e", 8, at(9000), False, False)]
    schema = "k string, order long, event_time timestamp, fin boolean, rst boolean"
    out = drain(spark, stateful.flow_sessions(stream(spark, tmp_path, rows, schema, 9, "f"), ["k"], 300), tmp_path, "sessions")
    got = sorted((r.k, r.packets, r.close_reason) for r in out.collect())
    assert got == [("a", 1, "Timeout"), ("a", 3, "Fin"), ("b", 1, "Timeout"), ("c", 1, "Rst"), ("d", 1, "Timeout"), ("d", 1, "Timeout")]


def test_state_of_windows_falls_to_zero(spark, tmp_path):
    """Keys come and go: after each batch only those near the watermark are held."""
    rows = [(k, 10 * k + i, 1000 + 100 * k + i) for k in range(30) for i in range(5)] + [(99, 9999, 10**6)]
    made = stream(spark, tmp_path, rows, "k int, n long, t long", 16, "z").withColumn("event_time", F.timestamp_seconds("t"))
    df = stateful.anchored_windows(made, ["k"], "n", "t", 10)
    q = df.writeStream.format("memory").queryName("zero").outputMode("append").option("checkpointLocation", str(tmp_path / "cp-z")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("zero").count() == 151 and spark.table("zero").where("win_count = 5").count() == 30
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) < 12 and held[-1] == 1


def test_modbus_pairs_of_a_stream(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    c, s = "ClientToServer", "ServerToClient"
    key = (b"a", 1, b"b", 502, 7)
    rows = [(*key, at(0), c, 1, 1, 3), (*key, at(0), c, 2, 1, 6), (*key, at(2), s, 1, 1, 3), (*key, at(3), s, 2, 1, 0x83), (*key, at(4), s, 2, 1, 0x86), (*key, at(5), c, 3, 1, 3), (*key, at(30), s, 3, 1, 3), (*key, at(31), s, 9, 1, 3), (b"z", 1, b"b", 502, 1, at(900), c, 1, 1, 3), (b"z", 1, b"b", 502, 1, at(9000), c, 1, 1, 3)]
    schema = "lower_key binary, lower_port int, upper_key binary, upper_port int, began long, event_time timestamp, direction string, txn int, unit int, fc int"
    for parts in (1, 5):
        out = drain(spark, stateful.modbus_pairs(stream(spark, tmp_path, rows, schema, parts, f"m{parts}")), tmp_path, f"pairs{parts}").where("asked < timestamp'2024-01-01 00:10:00'").collect()
        assert sorted((r.txn, r.request_fc, r.response_fc or 0, r.seconds or -1) for r in out) == [(1, 3, 3, 2), (2, 6, 0x86, 4), (3, 3, 0, -1)]
