"""Large classic captures read in ranges: the same rows as one walk, whatever the payloads look like."""

import random
import struct

import build as b
import pytest

from packetloom.sources import splits
from packetloom.sources.capture import read_captures


def record(secs, fraction, data, order="<"):
    return struct.pack(f"{order}IIII", secs, fraction, len(data), len(data)) + data


def rows(df):
    return sorted(((r.file_seq, r.pkt_idx, r.ts_secs, r.ts_usecs, r.datalink, None if r.data is None else bytes(r.data), r.error) for r in df.collect()), key=lambda r: r[:2])


def payloads(rng, kind, n):
    """Packets whose contents are other captures' records, chains of empty records, zeros, or noise."""
    out = []
    for i in range(n):
        if kind == "nested":
            out.append(b"".join(record(1_700_000_000 + k, 5, rng.randbytes(rng.randrange(40))) for k in range(rng.randrange(60))))
        elif kind == "empty records":
            out.append(record(1_700_000_000, 7, b"") * rng.randrange(200))
        elif kind == "zeros":
            out.append(bytes(rng.randrange(3000)))
        elif kind == "huge":
            out.append(rng.randbytes(30_000 if i % 9 == 4 else 50))
        else:
            out.append(rng.randbytes(rng.randrange(200)))
    return out


@pytest.mark.parametrize("kind", ["nested", "empty records", "zeros", "huge", "noise"])
def test_ranges_give_the_rows_of_one_walk(spark, tmp_path, kind):
    rng = random.Random(kind)
    for k, (order, nanos) in enumerate([("<", False), (">", True)]):
        packets = [(1_700_000_000 + i, i, p) for i, p in enumerate(payloads(rng, kind, 120))]
        (tmp_path / f"{k}.pcap").write_bytes(b.pcap(packets, order=order, nanos=nanos))
    (tmp_path / "small.pcap").write_bytes(b.pcap([(1, b"x")]))
    want = rows(read_captures(spark, str(tmp_path)))
    assert len(want) == 241
    assert rows(read_captures(spark, str(tmp_path), split_bytes=4000)) == want
    if kind == "noise":
        assert rows(read_captures(spark, str(tmp_path), split_bytes=700)) == want


def test_an_error_anywhere_takes_back_the_file(spark, tmp_path):
    rng = random.Random(1)
    good = b.pcap([(1_700_000_000 + i, i, rng.randbytes(100)) for i in range(200)])
    at = 24 + 120 * 116  # the 121st record
    (tmp_path / "a.pcap").write_bytes(good[:-1])
    (tmp_path / "b.pcap").write_bytes(good + bytes(9))
    (tmp_path / "c.pcap").write_bytes(good[: at + 8] + struct.pack("<I", 1 << 30) + good[at + 12 :])
    (tmp_path / "d.pcap").write_bytes(good)
    (tmp_path / "e.pcap").write_bytes(b.pcap([(1, bytes(100))] * 100, link=147))
    whole, parts = rows(read_captures(spark, str(tmp_path))), rows(read_captures(spark, str(tmp_path), split_bytes=2000))
    assert whole == parts and len(whole) == 204
    errors = {r[0]: r[6] for r in parts if r[6]}
    assert errors == {0: "packet record ends early", 1: "record header ends early", 2: "packet record ends early", 4: "unsupported link type 147"}


def test_pushed_paths_and_numbers(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.pcap").write_bytes(b.pcap([(k, bytes([k]) * 100)] * 50))
    df = read_captures(spark, str(tmp_path), split_bytes=1000)
    assert df.rdd.getNumPartitions() == 3 * 6
    only = df.where(df.path == f"{tmp_path}/1.pcap")
    assert [r.pkt_idx for r in only.orderBy("pkt_idx").collect()] == list(range(50)) and only.rdd.getNumPartitions() == 6


def test_guesses_are_found_in_plain_files(tmp_path):
    """Ranges of an ordinary file agree at once: no range has to be walked again."""
    import pyarrow.fs as pafs

    rng = random.Random(3)
    data = b.pcap([(1_700_000_000 + i // 9, i, rng.randbytes(rng.randrange(60, 1400))) for i in range(3000)])
    path = tmp_path / "x.pcap"
    path.write_bytes(data)
    with pafs.LocalFileSystem().open_input_file(str(path)) as f:
        window = splits.FileWindow(f, len(data))
        leave = 24
        for begin in range(0, len(data), 100_000):
            stop = min(len(data), begin + 100_000)
            if begin:
                assert splits.guess(window, begin, stop, "<", 1_000_000) == leave
            leave, _ = splits.walk(window, leave, stop, "<")
        assert leave == len(data)


def test_reads_and_tasks_do_not_grow_with_the_number_of_ranges(spark, tmp_path, monkeypatch):
    """Short ranges of one task share what is read of a file, and are scanned in a bounded number of partitions."""
    reads = []

    class Counted:
        def __init__(self, data):
            self.data = data

        def read_at(self, n, at):
            reads.append(n)
            return self.data[at : at + n]

    record = struct.pack("<IIII", 1000, 5, 40, 40) + bytes(40)
    data = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + record * 4000
    window = splits.FileWindow(Counted(data), len(data))
    at, total = splits.HEADER, 0
    for begin in range(0, len(data), 1000):
        stop = min(len(data), begin + 1000)
        if begin:
            assert splits.guess(window, begin, stop, "<", 1_000_000) == (at if at < stop else None)
        at, n = splits.walk(window, at, stop, "<")
        total += n
    assert total == 4000 and sum(reads) < 3 * len(data)

    ranges = [{"file_seq": i // 3000, "entry": 100 * (i % 3000), "leave": 100 * (i % 3000) + 100, "first": i % 3000, "packets": 1, "error": None} for i in range(9000)]
    made = splits.joined(ranges)
    assert len(made) < 300 and sum(r["packets"] for r in made) == 9000
    assert splits.joined(ranges[:10]) == ranges[:10]
