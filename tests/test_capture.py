"""Capture source and decoding."""

import struct

import build as b
import pytest

from packetloom.operators import decode, summary
from packetloom.sources.capture import captures, read_captures


@pytest.fixture
def read(spark, tmp_path):
    def go(**files):
        for name, data in files.items():
            (tmp_path / f"{name}.pcap").write_bytes(data)
        return read_captures(spark, str(tmp_path))

    return go


def test_classic_variants(read):
    data = b.udp("1.2.3.4", 5, "5.6.7.8", 53, b"x")
    raw = read(
        a=b.pcap([(7, 9, data)]), b=b.pcap([(7, 9, data)], order=">"), c=b.pcap([(7, 9000, data)], nanos=True), d=b.pcap([(7, 9999, data)], order=">", nanos=True), e=b"not a capture", f=b.pcap([(7, data)], link=9), g=b.pcap([(7, data)])[:-1], h=b.pcap([]),
    )
    rows = {r.path[-6]: r for r in raw.collect()}
    assert sorted(rows) == list("abcdfgh")
    assert all((rows[k].ts_secs, rows[k].ts_usecs, bytes(rows[k].data)) == (7, 9, data) for k in "abcd")
    assert "link type" in rows["f"].error and "early" in rows["g"].error and rows["h"].error is None and rows["h"].pkt_idx == -1
    per = {r.path[-6]: r for r in captures(raw).collect()}
    assert per["a"].packets == 1 and per["g"].packets == 0 and per["h"].packets == 0


def test_pcapng_blocks_and_errors(read):
    d = b.udp("1.2.3.4", 5, "5.6.7.8", 53, b"x")
    s, i = b.section(), b.interface()
    stamp = 1_700_000_000_123_456
    raw = read(
        a=s + i + b.enhanced(stamp, d) + b.simple(d) + b.block(5, b"1234") + b.block(2, b"12345678"),
        b=b.section(">") + b.interface(order=">", resolution=9) + b.enhanced(1_700_000_000_000_005_000, d, ">"),
        c=s + b.enhanced(stamp, d), d=s + i + b.enhanced(stamp, d, iface=3), e=s + i + b.interface(101), f=s + i + b.enhanced(stamp, d) + i, g=s + i + s,
        h=s + b.interface(resolution=0x80 | 10) + b.enhanced(1024 * 5 + 512, d), k=s + i + b.enhanced(stamp, d)[:-4], m=b.section(major=2),
        n=s + i + struct.pack("<III", 6, 14, 14), p=s + i + b.enhanced(stamp, d)[:-4] + struct.pack("<I", 96), q=s + b.block(1, struct.pack("<HHI", 1, 7, 0)), r=s + i + b.enhanced(stamp, d) + b.block(1, struct.pack("<HHI", 1, 7, 0)), t=s[:20],
    )
    rows = {}
    for r in raw.collect():
        rows.setdefault(r.path[-6], []).append(r)
    a = sorted(rows["a"], key=lambda r: r.pkt_idx)
    assert [(r.ts_secs, r.ts_usecs) for r in a] == [(1_700_000_000, 123_456), (0, 0)] and (a[0].skipped_blocks, a[0].opb_skipped) == (2, 1)
    assert (rows["b"][0].ts_secs, rows["b"][0].ts_usecs) == (1_700_000_000, 5) and (rows["h"][0].ts_secs, rows["h"][0].ts_usecs) == (5, 500_000)
    for k, code in (("c", "009"), ("d", "010"), ("e", "011"), ("f", "013"), ("g", "012"), ("k", "010"), ("m", "008"), ("n", "010"), ("p", "010"), ("q", "008"), ("r", "008"), ("t", "010")):
        assert f"E-INP-{code}" in rows[k][0].error and len(rows[k]) == 1 and rows[k][0].data is None


def decoded(spark, *frames, link=1):
    raw = spark.createDataFrame([(0, i, 1_700_000_000, link, f) for i, f in enumerate(frames)], "file_seq int, pkt_idx long, ts_secs long, datalink int, data binary")
    return decode.packets(raw)


def test_frames(spark):
    six = bytes.fromhex("20010db8000000000000000000000001"), bytes.fromhex("fe800000000000010000000000000000")
    ext = bytes([44, 0, 1, 4, 0, 0, 0, 0]) + bytes([6, 0, 0, 0, 0, 0, 0, 1])
    segment = struct.pack(">HHIIBBHHH", 1, 443, 9, 0, 5 << 4, b.SYN, 0, 0, 0) + b"hi"
    frames = [
        b.tcp("10.0.0.1", 1, "10.0.0.2", 80, 2**32 - 1, b.SYN | b.ACK, b"GET", vlans=(0x88A8, 0x8100)),
        b.udp("10.0.0.1", 53, "10.0.0.2", 9, b"abc") + b"\0" * 9,
        b.ipv4("1.1.1.1", "2.2.2.2", 1, b"\x08" + b"\0" * 7),
        b.ipv4("1.1.1.1", "2.2.2.2", 89, b"zz"),
        b.ipv4("1.1.1.1", "2.2.2.2", 17, b"\0" * 30, frag=0x2000),
        b.ipv6(*six, 0, ext + segment),
        b.tcp("10.0.0.1", 1, "10.0.0.2", 80, 5, payload=b"A" * 100)[:-60],
        b.ether(0x9999, b"x" * 40),
        b.ether(0x0800, b"\x45" + b"\0" * 9),
        b.ether(0x0800, b"\x55" + b"\0" * 30),
        b.arp(1, b"\x02" * 6, "10.0.0.9", b"\0" * 6, "10.0.0.1"),
        b.arp(1, b"\x02" * 6, "10.0.0.9", b"\0" * 6, "10.0.0.1", shape=(1, 0x0800, 6, 8)),
        b.arp(1, b"\x02" * 6, "10.0.0.9", b"\0" * 6, "10.0.0.1")[:30],
        b"\1\2\3",
    ]
    r = sorted(decoded(spark, *frames).collect(), key=lambda x: x.pkt_idx)
    assert (r[0].kind, r[0].protocol, r[0].src_port, r[0].seq, r[0].syn, r[0].ack, r[0].fin, bytes(r[0].payload)) == ("ip", "Tcp", 1, 2**32 - 1, True, True, False, b"GET")
    assert (r[1].protocol, bytes(r[1].payload), r[1].packet_len) == ("Udp", b"abc", len(frames[1]))
    assert [x.protocol for x in r[2:5]] == ["Icmp", "Other(89)", "Other(17)"] and r[4].src_port is None
    assert (r[5].src_ip, r[5].dst_ip, r[5].protocol, r[5].dst_port, bytes(r[5].payload)) == ("2001:db8::1", "fe80:0:0:1::", "Tcp", 443, b"hi")
    assert bytes(r[6].payload) == b"A" * 40
    assert [x.kind for x in r[7:]] == ["error"] * 3 + ["arp"] + ["error"] * 3
    assert r[10].arp.operation == 1 and bytes(r[10].arp.sender_ip) == bytes([10, 0, 0, 9])
    assert (r[11].decode_error, r[12].decode_error) == (decode.MALFORMED_ARP, decode.TRUNCATED_ARP)


def test_other_links(spark):
    ip = b.tcp("10.0.0.1", 1, "10.0.0.2", 80, 5)[14:]
    assert decoded(spark, ip, link=101).first().protocol == "Tcp"
    assert decoded(spark, ip, link=228).first().dst_ip == "10.0.0.2"
    assert decoded(spark, b"\0" * 14 + b"\x08\0" + ip, link=113).first().src_ip == "10.0.0.1"


def test_summary(spark):
    p = decoded(spark, b.udp("10.0.0.1", 53, "10.0.0.2", 9, b"\0\0\x80" + b"\0" * 12), b.udp("10.0.0.2", 9, "10.0.0.1", 53, b"\0" * 12), b.tcp("10.0.0.1", 1, "10.0.0.10", 443, 5), b.ether(0x9999, b"x" * 40), b.arp(1, b"\x02" * 6, "1.1.1.1", b"\0" * 6, "2.2.2.2"))
    assert tuple(summary.totals(p).first())[::2] == (3, 1)
    assert [r.host for r in summary.hosts(p).orderBy("host_key").collect()] == ["10.0.0.1", "10.0.0.2", "10.0.0.10"]
    assert [tuple(r) for r in summary.protocols(p).collect()] == [("Udp", 2), ("Tcp", 1)]
    assert [tuple(r) for r in summary.services(p).collect()] == [("DNS", 2), ("TLS", 1)]
    assert tuple(summary.dns(p).first()) == (1, 1)
