"""Modbus transactions: outcomes, the bound of waiting requests, and instances told apart in the pass of reassembly."""

import random
import struct

import build as b
from pyspark.sql import functions as F

from packetloom.operators import decode, dispatch, flows, modbus, reassembly


def unit(txn, fc, tail=b"\0\1\0\2", unit=1):
    return struct.pack(">HHHBB", txn, 0, 2 + len(tail), unit, fc) + tail


def indexed(spark, frames):
    raw = spark.createDataFrame([(0, i, ts, 1, f) for i, (ts, f) in enumerate(frames)], "file_seq int, pkt_idx long, ts_secs long, datalink int, data binary")
    return flows.ip_index(decode.packets(raw))


def outcomes(spark, frames, **kw):
    tcp = flows.keyed(indexed(spark, frames).where("protocol = 'Tcp'"))
    found = modbus.units(dispatch.dispatch(reassembly.chunks(reassembly.reassemble(tcp))), **kw)
    return [(r.txn, r.fc, r.outcome, r.request_fc, r.seconds) for r in modbus.pairs(found).orderBy("at", "sub").collect()]


def test_outcomes_in_order(spark):
    t = b.Talk(sport=502)
    t.send(unit(1, 3)).send(unit(1, 3, b"\2\0\1"), client=False, dt=4).send(unit(1, 3, b"\2\0\1"), client=False)
    t.send(unit(2, 6)).send(unit(2, 0x83, b"\1"), client=False).send(unit(2, 6), dt=1).send(unit(2, 0x86, b"\2"), client=False, dt=2)
    t.send(unit(3, 3, unit=9)).send(unit(3, 3, unit=8), client=False).send(unit(3, 16, unit=9), client=False).send(unit(4, 0x90, b"\1"))
    assert outcomes(spark, t.packets) == [
        (1, 3, "request", 3, None), (1, 3, "matched", 3, 4), (1, 3, "orphan", None, None), (2, 6, "request", 6, None), (2, 0x83, "mismatch", 6, None), (2, 6, "duplicate", 6, None),
        (2, 0x86, "exception", 6, 2), (3, 3, "request", 3, None), (3, 3, "orphan", None, None), (3, 16, "matched", 3, 0),
    ]


def test_as_many_requests_wait_as_the_bound_says(spark):
    t = b.Talk(sport=502)
    n = modbus.MOST_PENDING
    assert n == 256
    for k in range(n + 1):
        t.send(unit(k, 3))
    t.send(unit(5, 3))  # one that waits may be asked again
    for k in (n, n - 1):
        t.send(unit(k, 3, b"\2\0\1"), client=False)
    t.send(unit(n, 3))
    got = outcomes(spark, t.packets)
    assert [o for _, _, o, *_ in got] == ["request"] * n + ["dropped", "duplicate", "orphan", "matched", "request"]
    few = outcomes(spark, t.packets, most_pending=2)
    assert [o for _, _, o, *_ in few[:4]] == ["request", "request", "dropped", "dropped"]


def test_instances_of_the_pass_are_those_of_the_windows(spark):
    rng, frames, ts = random.Random(8), [], 1_700_000_000
    for _ in range(400):
        ts += rng.choice([0, 1, 5, 5, 400 if rng.random() < 0.2 else 1, -3])
        flags = rng.choice([b.ACK] * 5 + [b.SYN, b.FIN | b.ACK, b.RST])
        frames.append((ts, b.tcp("10.0.0.1", rng.choice([1, 2]), "10.0.0.2", 80, rng.randrange(50), flags, b"ab" * rng.randrange(4))))
    ip = indexed(spark, frames)
    config = flows.FlowConfig(sweep_packets=16, idle_packets=30)
    rows = [sorted(map(repr, reassembly.reassemble(tcp, config).withColumn("stats", F.sort_array(F.map_entries("stats"))).collect())) for tcp in (flows.instances(ip, config), flows.keyed(ip.where("protocol = 'Tcp'")))]
    assert rows[0] == rows[1] and len(rows[0]) > 100


def test_classes_of_dnp3_codes(spark):
    """Every code has one class."""
    from packetloom.operators import dnp3

    got = {r.fc: r.c for r in spark.range(256).select(F.col("id").alias("fc"), dnp3.code_class(F.col("id")).alias("c")).collect()}
    want = {1: "Read", 2: "Write", 13: "Restart", 14: "Restart", **dict.fromkeys(range(3, 7), "Control"), **dict.fromkeys(range(0x81, 0x84), "Response")}
    assert all(got[k] == want.get(k, "Management" if k <= 0x1A else "Unknown") for k in range(256))
