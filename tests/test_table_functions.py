"""Table functions in SQL against the operators."""

import struct

import build as b
from pyspark.sql import functions as F

from packetloom.operators import decode, dispatch, enip, flows, modbus, reassembly, table_functions


def test_units_of_many_flows(spark):
    frames = []
    for k in range(12):
        t = b.Talk(cport=40_000 + k, sport=502, ts=1_700_000_000 + k)
        for i in range(6):
            body = struct.pack(">HHHBB", i % 3, 0, 6, k, [3, 6, 16, 5, 0x11, 3][i]) + b"\0\1\0\2"
            t.send(body[:5]).send(body[5:] + (b"\0\1\0\2" * 80 if k == 7 and i == 5 else b""), dt=i % 2).send(body, client=False)
        frames += t.packets
    raw = spark.createDataFrame([(0, i, ts, 1, f) for i, (ts, f) in enumerate(frames)], "file_seq int, pkt_idx long, ts_secs long, datalink int, data binary")
    made = reassembly.reassemble(flows.keyed(flows.ip_index(decode.packets(raw)).where("protocol = 'Tcp'")))
    routed = dispatch.dispatch(reassembly.chunks(made))
    table_functions.register(spark)
    routed.withColumn("flow_id", F.concat_ws("#", "flow", "inst")).select("flow_id", "ip_idx", "sub", "ts", "direction", "data").createOrReplaceTempView("chunks")
    got = spark.sql("SELECT at, sub, ts, direction, what, txn, unit, fc, burst_count, outcome, seconds FROM modbus_units(TABLE(chunks) PARTITION BY flow_id ORDER BY (ip_idx, sub))")
    want = modbus.units(routed)
    want = want.join(modbus.fields(want).select("at", "sub", "txn", "unit", "fc"), ["at", "sub"], "left").select("at", "sub", "ts", "direction", "what", "txn", "unit", "fc", "burst.win_count", "outcome", "seconds")
    rows = sorted(map(repr, map(tuple, got.collect())))
    assert rows == sorted(map(repr, map(tuple, want.collect()))) and len(rows) > 130 and any("'error'" in r for r in rows)


def test_items_of_frames(spark):
    item = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    datas = [b"", b"\1", struct.pack("<H", 0), struct.pack("<H", 2) + item(0, b"") + item(0xB2, b"abc"), struct.pack("<H", 3) + item(1, b"x") + item(2, b"yy")[:-1], struct.pack("<H", 9) + item(5, b"z"), None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(datas)], "id int, data binary")
    df.createOrReplaceTempView("frames_of_items")
    table_functions.register(spark)
    got = spark.sql("SELECT id, i.nth, i.type, i.data FROM frames_of_items, LATERAL cpf_items(data) i").collect()
    want = df.select("id", F.posexplode(enip.items(F.col("data"))).alias("nth", "x")).select("id", "nth", "x.type", "x.data").collect()
    assert sorted((r.id, r.nth, r.type, bytes(r.data)) for r in got) == sorted((r.id, r.nth, r.type, bytes(r.data)) for r in want) and len(got) == 4
