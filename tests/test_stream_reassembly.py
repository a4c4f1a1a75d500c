"""Streaming reassembly against the batch operator, over any split into micro-batches and any order of arrival."""

import random
import time
from collections import Counter

import build as b
import pytest
from pyspark.sql import functions as F

from packetloom.operators import decode, flows, reassembly
from packetloom.streaming import reassembly as live

START = 1_700_000_000
CONFIG = flows.FlowConfig(small_threshold=2, out_of_window_threshold=1, overlap_threshold=0)


@pytest.fixture
def store(spark):
    spark.conf.set(*live.STATE_STORE)
    yield
    spark.conf.unset(live.STATE_STORE[0])


def packets(spark, frames):
    """Keyed TCP packets of (seconds, frame), numbered from 1."""
    raw = spark.createDataFrame([(0, i, ts, 1, f) for i, (ts, f) in enumerate(frames)], "file_seq int, pkt_idx long, ts_secs long, datalink int, data binary")
    indexed = flows.ip_index(decode.packets(raw))
    keyed = flows.keyed(indexed.where("protocol = 'Tcp'"))
    return flows.instances(indexed), keyed.withColumn("event_time", F.timestamp_seconds(F.col("ts")))


def talks(rng):
    """Conversations with gaps, retransmissions, conflicts, resets, FINs, idle times and reused ports, a packet a second."""
    per = []
    for k in range(7):
        frames, seq, client = [], 1000, f"10.0.0.{k % 5 + 1}"
        ends = (client, 40_000, "10.0.1.1", 80 if k % 2 else 502)
        if k % 3:
            frames.append(b.tcp(*ends, seq, b.SYN))
        parts, at = [], 1
        for _ in range(rng.randrange(4, 16)):
            data = rng.choice([b"GET /", b"x" * 20, bytes(rng.randrange(65, 90) for _ in range(rng.randrange(1, 9)))])
            parts.append((at, data))
            at += len(data)
        parts += [(a, bytes(len(d))) for a, d in rng.sample(parts, 2)] + rng.sample(parts, 2)
        for i in range(len(parts) - 1):
            if rng.random() < 0.3:
                parts[i], parts[i + 1] = parts[i + 1], parts[i]
        frames += [b.tcp(*ends, seq + a, b.ACK, d) for a, d in parts]
        frames.insert(rng.randrange(1, len(frames)), b.tcp(*ends[2:], *ends[:2], 7777, b.ACK, b"HTTP/1.1 200 OK\r\n"))
        if k % 4 == 0:
            frames.append(b.tcp(*ends, seq + at, b.RST))
        elif k % 4 == 1:
            frames += [b.tcp(*ends, seq + at, b.FIN | b.ACK), b.tcp(*ends[2:], *ends[:2], 7777 + 17, b.FIN | b.ACK)]
        per.append(frames)
    out, ts = [], START
    while any(per):
        own = rng.choice([x for x in per if x])
        ts += rng.choice([1, 1, 2, 400 if rng.random() < 0.05 else 1])
        out.append((ts, own.pop(0)))
    return out


def drain(spark, df, parts, tmp_path, name, **kw):
    """All rows of the streaming form over ``parts``, lists of ip_idx, a micro-batch each."""
    folder = tmp_path / name
    rows = {r.ip_idx: r for r in df.collect()}
    for own in parts:
        spark.createDataFrame([rows[i] for i in own], df.schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.02)  # files are read in order of their times
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    made = live.reassemble(stream, **kw)
    q = made.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.table(name).collect(), q


def facts(rows, began):
    """Chunks, findings and sums of counters that don't depend on how flows are numbered."""
    chunk = {(began(r), r.ip_idx, r.direction, r.offset, bytes(r.data), r.route) for r in rows if r.what == "chunk"}
    found = Counter((began(r), r.ip_idx, r.summary, tuple(r.evidence), r.direction, r.verdict) for r in rows if r.what == "finding")
    stats = Counter()
    for r in rows:
        stats.update(r.stats or {})
    return chunk, found, {k: v for k, v in stats.items() if v}


@pytest.mark.parametrize("seed, n_parts, lateness", [(1, 1, None), (1, 9, None), (2, 5, None), (2, 6, "5000 seconds"), (3, 8, "5000 seconds")])
def test_stream_equals_batch(spark, store, tmp_path, seed, n_parts, lateness):
    rng = random.Random(seed)
    frames = talks(rng)
    frames.append((START + 10**6, b.tcp("9.9.9.9", 1, "9.9.9.8", 2, 5, b.SYN)))  # moves the watermark past all others
    tcp, keyed = packets(spark, frames)
    batch = reassembly.reassemble(tcp, CONFIG).collect()
    first = {}
    for r in tcp.collect():
        k = (bytes(r.lower_key), r.lower_port, bytes(r.upper_key), r.upper_port, r.inst)
        first[k] = min(first.get(k, r.ip_idx), r.ip_idx)
    want = facts([r for r in batch if "9.9.9.9" not in r.flow], lambda r: first[bytes(r.lower_key), r.lower_port, bytes(r.upper_key), r.upper_port, r.inst])
    order = list(range(1, len(frames)))
    if lateness:
        rng.shuffle(order)  # any arrival within the lateness
    cuts = sorted(rng.sample(range(1, len(order)), n_parts - 1))
    parts = [order[i:j] for i, j in zip([0, *cuts], [*cuts, len(order)], strict=True)] + [[len(frames)]]
    got, q = drain(spark, keyed, parts, tmp_path, f"s{seed}{n_parts}", config=CONFIG, lateness=lateness)
    assert facts([r for r in got if "9.9.9.9" not in r.flow], lambda r: r.began) == want
    assert len(want[0]) > 20 and want[1]
    closed = [r for r in got if r.what == "stats"]
    assert {r.close_reason for r in closed} >= {"Rst", "Fin", "Timeout"}
    # Only the last flow is left in the state: one row of numbers and its timer, or the packet that waits.
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


def test_packets_behind_the_watermark_are_dropped(spark, store, tmp_path):
    ends = ("10.0.0.1", 40_000, "10.0.1.1", 80)
    frames = [(START, b.tcp(*ends, 100, b.SYN)), (START + 1, b.tcp(*ends, 101, b.ACK, b"late")), (START + 2, b.tcp(*ends, 105, b.ACK, b"next")), (START + 100, b.tcp("9.9.9.9", 1, "9.9.9.8", 2, 5, b.SYN)), (START + 101, b.tcp("9.9.9.9", 1, "9.9.9.8", 2, 6, b.ACK)), (START + 5000, b.tcp("9.9.9.9", 1, "9.9.9.8", 2, 6, b.ACK))]
    _, keyed = packets(spark, frames)
    got, _ = drain(spark, keyed, [[1, 3, 4], [5], [2], [6]], tmp_path, "late", lateness="10 seconds")
    assert not [r for r in got if r.what == "chunk"]  # "next" waits for bytes that came too late
    got, _ = drain(spark, keyed, [[1, 3], [2], [4], [5], [6]], tmp_path, "intime", lateness="10 seconds")
    assert [bytes(r.data) for r in sorted(got, key=lambda r: r.sub) if r.what == "chunk"] == [b"late", b"next"]


def test_a_bound_of_waiting_packets(spark, store, tmp_path):
    ends = ("10.0.0.1", 40_000, "10.0.1.1", 80)
    frames = [(START + i, b.tcp(*ends, 100 + i, b.ACK, b"%d" % i)) for i in range(8)] + [(START + 5000, b.tcp("9.9.9.9", 1, "9.9.9.8", 2, 6, b.ACK))]
    _, keyed = packets(spark, frames)
    got, _ = drain(spark, keyed, [[*range(1, 9)], [9]], tmp_path, "bound", lateness="1 hour", max_held=3)
    assert b"".join(bytes(r.data) for r in sorted(got, key=lambda r: r.sub) if r.what == "chunk") == b"01234567"
