"""Captures end to end: flows, reassembly, protocols, findings and reports."""

import json
import random
import struct

import build as b
import pytest

from packetloom.operators import flows, reassembly, report, tls
from packetloom.plans.analyze import Options, analyze


@pytest.fixture
def run(spark, tmp_path):
    def go(packets, options=Options()):
        folder = tmp_path / str(random.random())
        folder.mkdir()
        (folder / "a.pcap").write_bytes(b.pcap(packets))
        return analyze(spark, str(folder), options=options)

    return go


def texts(a):
    return [r.summary for r in a.findings.orderBy("stage", "at", "sub").collect()]


def details(a):
    return {r.analyzer_name: json.loads(r.detail) for r in a.summaries.collect()}


def test_http(run):
    t = b.Talk()
    t.send(b"GET /a/../etc HTTP/1.1\r\nHost: x.example\r\nUser-Agent: \r\n\r\nDELETE /wp-admin")
    t.send(b" HTTP/1.1\r\nHost:\r\n\r\n").send(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n", client=False)
    t.send(b"GET /" + b"a" * 3000 + b" HTTP/1.0\r\n" + b"A: b\r\n" * 97 + b"\r\n").send(b"GET /" + b"a" * 3000 + b" HTTP/1.0\r\n\r\n").close()
    a = run(t.packets, Options(analyzers=("http",)))
    got = texts(a)
    assert got == [
        "Path traversal in URI: /a/../etc", "Empty User-Agent header", "Admin panel access: /wp-admin", "Unusual HTTP method: DELETE", "HTTP/1.1 request with empty Host header",
        "Excessive HTTP headers exceeded parser limit (possible DoS or header-based attack)", "Abnormally long URI (3001 chars)",
    ]
    d = details(a)["HTTP"]
    assert d["transactions"] == 1 and d["methods"] == {"GET": 2, "DELETE": 1} and d["status_codes"] == {"200": 1} and d["top_hosts"] == ["", "x.example"] and d["parse_errors"] == 1
    assert d["recent_uris"] == ["/a/../etc", "/wp-admin", "/" + "a" * 3000] and set(d) == {"transactions", "methods", "status_codes", "top_hosts", "recent_uris", "user_agents", "parse_errors", "non_http_flows", "poisoned_bytes_skipped"}
    stats = details(a)["TCP Reassembly"]
    assert (stats["flows_total"], stats["flows_fin"], stats["flows_completed"], stats["unclassified_flows"]) == (1, 1, 1, 0)


def hello(ciphers, exts, version=0x0303, client=True):
    body = struct.pack(">H", version) + bytes(32) + b"\0"
    body += struct.pack(">H", 2 * len(ciphers)) + b"".join(struct.pack(">H", c) for c in ciphers) + b"\1\0" if client else struct.pack(">H", ciphers[0]) + b"\0"
    raw = b"".join(struct.pack(">HH", k, len(v)) + v for k, v in exts)
    body += struct.pack(">H", len(raw)) + raw
    message = bytes([1 if client else 2]) + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + struct.pack(">H", len(message)) + message


def test_tls(run):
    import hashlib

    sni = lambda name: (0, struct.pack(">HBH", len(name) + 3, 0, len(name)) + name)
    exts = [(0x1A1A, b""), sni(b"a\x01b"), (10, b"\0\4\x0a\x0a\0\x1d"), (11, b"\1\0")]
    data = hello([0x0A0A, 0x1301, 0x0001, 0x0018], exts, 0x0300)
    t = b.Talk(sport=9443)
    t.send(data[:20]).send(data[20:]).send(hello([0x0005], [(65281, b"\0")], client=False), client=False).close()
    a = run(t.packets, Options(analyzers=("tls",)))
    got = texts(a)
    assert got[0].startswith("TLS SNI contains ASCII control characters") and got[1] == "ClientHello offers weak cipher suites (NULL/anonymous/export)"
    assert "SSL 3.0" in got[2] and got[3] == "ServerHello selected weak cipher suite (TLS_RSA_WITH_RC4_128_SHA)" and len(got) == 4
    d = details(a)["TLS"]
    ja3 = "768,4865-1-24,0-10-11,29,0"
    assert list(d["ja3_hashes"]) == [hashlib.md5(ja3.encode()).hexdigest()] and list(d["ja3s_hashes"]) == [hashlib.md5(b"771,5,65281").hexdigest()]
    assert d["cipher_suites"] == {"TLS_RSA_WITH_RC4_128_SHA": 1} and d["handshakes"] == 1


def adu(fc, body=b"", txn=1, unit=9):
    return struct.pack(">HHHBB", txn, 0, 2 + len(body), unit, fc) + body


def test_modbus(run):
    t = b.Talk(sport=502)
    t.send(adu(0x11) + adu(0x2B, b"\x0e\1")).send(adu(0x63)).send(adu(0x08, b"\0\1")).send(adu(0x08, b"\0\x0a"))
    t.send(b"".join(adu(6, b"\0\1\0\2", txn=i) for i in range(22)))
    for i in range(6):
        t.send(adu(0x83, b"\x02"), client=False)
    t.send(adu(5, b"\0\1\0\2"), dt=30)
    t.send(b"\1\2\3\4\5\6\7\x08").close()
    a = run(t.packets, Options(analyzers=("modbus",)))
    got = [(r.summary.split(":")[0], r.mitre_techniques, r.source_ip) for r in a.findings.orderBy("stage", "at", "sub").collect()]
    assert [g[0] for g in got[:5]] == ["Modbus recon", "Modbus recon", "Modbus unknown function code", "Modbus Diagnostics DoS sub-function 0x0001 detected", "Modbus anti-forensic"]
    writes = [g for g in got if g[0] == "Modbus write command observed"]
    assert len(writes) == 23 and writes[0][1] == ["T1692.001", "T0836"] and writes[1][1] == ["T1692.001", "T0836", "T0831"] and writes[2][1] == writes[0][1] and writes[-1][1] == ["T1692.001", "T0835"]
    assert [g[1] for g in got if g[0] == "Modbus write burst"] == [["T0806", "T1692.001"]]
    assert "Modbus recon: 6 Illegal Data Address exceptions in window (unit 9) — possible register map enumeration" in texts(a)
    assert {g[2] for g in writes} == {"10.0.0.1"}
    d = details(a)["modbus"]
    assert (d["pdu_count"], d["write_count"], d["exception_count"], d["parse_errors"], d["dropped_findings"]) == (34, 23, 6, 1, 0) and d["function_code_distribution"]["0x06"] == 22


def link(fc, control=0xC4, dest=10, source=1, app=0xC0):
    user = bytes([0xC0, app, fc])
    head = b"\x05\x64" + bytes([5 + len(user), control]) + struct.pack("<HH", dest, source) + b"\0\0"
    return head + user + b"\0\0"


def test_dnp3(run):
    t = b.Talk(sport=20000)
    t.send(link(0x82, control=0x44)).send(link(0x14)).send(link(0x15)).send(link(0x02)).send(link(0x05, dest=0xFFFF))
    t.send(link(0x05, source=7)).send(b"".join(link(0x04, app=0xC0 | i % 16) for i in range(10)))
    t.send(link(0x0D)).send(link(0x01), dt=11).send(b"\x05\x64\x01" + bytes(12)).send(b"zz" * 6).send(b"zz" * 6).close()
    a = run(t.packets, Options(analyzers=("dnp3",)))
    got = texts(a)
    starts = ["DNP3 unexpected unsolicited response", "DNP3 ENABLE_UNSOLICITED", "DNP3 DISABLE_UNSOLICITED", "DNP3 WRITE", "DNP3 broadcast control command", "DNP3 unauthorized control command from unexpected source", "DNP3 unauthorized control command burst: 11", "DNP3 restart command observed", "DNP3 inferred blocked command", "DNP3 sustained loss-of-control pattern: 1 restart", "DNP3 structural anomaly: 3"]
    assert len(got) == len(starts) and all(g.startswith(s) for g, s in zip(got, starts, strict=True)), got
    assert "[0x0001]" in got[5]
    d = details(a)["DNP3"]
    assert d["function_code_distribution"]["4"] == 10 and d["flows_analyzed"] == 1 and d["control_operation_counts"] == {"0": 12} and set(d) == {"function_code_distribution", "control_operation_counts", "total_frames", "parse_errors", "flows_analyzed"}


def cip(service, path=b"", data=b""):
    body = bytes([service, len(path) // 2]) + path + data
    items = struct.pack("<HHHHH", 2, 0, 0, 0x00B2, len(body)) + body
    return enip(0x6F, b"\0" * 6 + items)


def enip(command, data=b""):
    return struct.pack("<HHII8sI", command, len(data), 77, 0, bytes(8), 0) + data


def test_enip(run):
    t = b.Talk(sport=44818)
    t.send(enip(0x63) + enip(0x63)).send(cip(0x0E, b"\x20\x01\x24\x01")).send(cip(0x07)).send(cip(0x05)).send(cip(0x54)).send(cip(0x4E)).send(cip(0x0E, b"\x20\x02"))
    for _ in range(51):
        t.send(cip(0x10, b"\x20\x02"))
    for i in range(6):
        t.send(cip(0xCC, b"", bytes([5 if i else 8, 0])), client=False)
    t.send(b"\xff" * 26).close()
    a = run(t.packets, Options(analyzers=("enip",)))
    got = texts(a)
    starts = ["EtherNet/IP ListIdentity", "CIP Identity Object", "CIP Stop", "CIP Reset", "CIP ForwardOpen", "CIP ForwardClose", "CIP write-class service burst: 51", "CIP error-response burst: 6", "EtherNet/IP structural anomaly: 3"]
    assert len(got) == len(starts) and all(g.startswith(s) for g, s in zip(got, starts, strict=True)), got
    d = details(a)["EtherNet/IP"]["enip_summary"]
    assert d == {"command_distribution": {"0x0063": 2, "0x006F": 63}, "total_pdu_count": 65, "write_count": 51, "error_count": 6, "parse_errors": 3, "flows_analyzed": 1, "dropped_findings": 0}


def test_arp(run):
    m = [bytes([2, 0, 0, 0, 0, i]) for i in range(4)]
    frames = [b.arp(1, m[1], "10.0.0.1", bytes(6), "10.0.0.2"), b.arp(2, m[2], "10.0.0.1", m[3], "10.0.0.3"), b.arp(2, m[1], "10.0.0.1", m[3], "10.0.0.1"), b.arp(2, m[3], "10.0.0.1", m[1], "10.0.0.9", outer=m[2]), b.arp(1, m[3], "0.0.0.0", m[1], "10.0.0.9"), b.arp(2, m[2], "10.0.0.7", m[2], "10.0.0.7"), b.arp(1, m[1], "10.0.0.1", bytes(6), "1.1.1.1", shape=(2, 0x0800, 6, 4))]
    storm = [b.arp(1, m[0], "10.9.9.9", bytes(6), "10.0.0.2")] * 60
    a = run([(1000 + i, f) for i, f in enumerate(frames)] + [(2000, f) for f in storm], Options(analyzers=("arp",)))
    rows = a.findings.orderBy("stage", "at", "sub").collect()
    assert [(r.summary[:4].rstrip(":"), r.verdict, r.confidence) for r in rows] == [
        ("D1: ".rstrip(": "), "Possible", "Medium"), ("D2: ".rstrip(": "), "Possible", "Medium"), ("D1", "Possible", "Medium"), ("D12", "Possible", "Medium"), ("D1", "Likely", "High"), ("D2", "Possible", "Low"), ("D11", "Possible", "Low"), ("D3", "Possible", "Medium"),
    ] or [r.summary[:4] for r in rows]
    d = details(a)["ARP"]
    assert (d["frames_analyzed"], d["spoof_findings"], d["garp_findings"], d["storm_findings"], d["mismatch_findings"], d["malformed_findings"], d["bindings_tracked"]) == (66, 3, 2, 1, 1, 1, 3)


def test_reassembly_is_the_same_in_any_order_and_first_bytes_win(spark, run):
    rng = random.Random(4)
    payload = bytes(rng.randrange(256) for _ in range(3000))
    t = b.Talk(sport=1234, isn=2**32 - 1500)
    first = t.at[True]
    parts = [(i, payload[i : i + n]) for i in range(0, 3000, 50) for n in (50, 50)]
    rng.shuffle(parts)
    packets = t.packets + [(t.ts, b.tcp(*t.c, *t.s, first + at, b.ACK, data)) for at, data in parts]
    packets.append((t.ts, b.tcp(*t.c, *t.s, first + 10, b.ACK, b"X" * 20)))
    a = run(packets, Options(analyzers=()))
    tcp = flows.instances(flows.ip_index(a.packets))
    chunks = reassembly.chunks(reassembly.reassemble(tcp)).orderBy("ip_idx", "sub").collect()
    assert b"".join(bytes(c.data) for c in chunks) == payload and chunks[0].offset == 1 and {c.direction for c in chunks} == {"ClientToServer"}


def test_conflicts_and_thresholds(run):
    t = b.Talk(sport=1234)
    first = t.at[True]
    hold = first + 100  # bytes that wait behind a gap
    packets = t.packets + [(t.ts, b.tcp(*t.c, *t.s, hold, b.ACK, b"A" * 40))]
    packets += [(t.ts, b.tcp(*t.c, *t.s, hold, b.ACK, b"B" * 40))] * 51
    packets += [(t.ts, b.tcp(*t.c, *t.s, first + 2**21, b.ACK, b"C"))] * 101
    packets += [(t.ts, b.tcp(*t.s, *t.c, t.at[False] + i, b.ACK, b"d")) for i in range(101)]
    got = texts(run(packets, Options(analyzers=())))
    flow = "10.0.0.1:40000 → 10.0.0.2:1234"
    assert got.count(f"Conflicting TCP segment overlap on flow {flow}") == 51
    assert [g for g in got if not g.startswith("Conf")] == [f"Excessive segment overlaps (51) on flow {flow}", f"Excessive out-of-window segments (101) on flow {flow}", f"Excessive consecutive small segments (101) on flow {flow}"]


def sequential(packets, timeout, sweep, idle):
    """Flow instances by a walk over all packets."""
    open_, out, clock, counts = {}, [], 0, {}
    for idx, p in enumerate(packets, 1):
        if p["ts"] > clock:
            clock = p["ts"]
            open_ = {k: f for k, f in open_.items() if not (clock > f["ts"] and clock - f["ts"] > timeout)}
        if idx % sweep == 0:
            open_ = {k: f for k, f in open_.items() if not idx - f["idx"] > idle}
        if p["key"] is None:
            continue
        if p["key"] not in open_:
            counts[p["key"]] = counts.get(p["key"], -1) + 1
            open_[p["key"]] = {"n": counts[p["key"]], "fins": 0}
        f = open_[p["key"]]
        f["ts"], f["idx"] = p["ts"], idx
        out.append((idx, f["n"]))
        f["fins"] += p["fin"] and not p["rst"]
        if p["rst"] or f["fins"] >= 2:
            del open_[p["key"]]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_flow_instances_match_a_walk(spark, run, seed):
    rng = random.Random(seed)
    ts, packets, plain = 1000, [], []
    for _ in range(400):
        ts += rng.choice([0, 0, 1, 2, 9, -3])
        k, flags = rng.randrange(6), rng.choice([b.ACK] * 6 + [b.FIN, b.FIN, b.RST, b.SYN])
        if k == 5:
            packets.append((ts, b.udp("10.0.0.1", 1, "10.0.0.2", 2)))
            plain.append({"ts": ts, "key": None, "fin": False, "rst": False})
        else:
            packets.append((ts, b.tcp("10.0.0.1", 100 + k, "10.0.0.2", 80, 5, flags)))
            plain.append({"ts": ts, "key": k, "fin": flags == b.FIN, "rst": flags == b.RST})
    a = run(packets, Options(analyzers=()))
    config = flows.FlowConfig(timeout=20, sweep_packets=16, idle_packets=40)
    got = flows.instances(flows.ip_index(a.packets), config).orderBy("ip_idx").collect()
    assert [(r.ip_idx, r.inst) for r in got] == sequential(plain, 20, 16, 40)


def test_reports(spark, run, tmp_path):
    t = b.Talk()
    for _ in range(5):
        t.send(b"GET /=../x HTTP/1.1\r\nHost: h\x1b\r\n\r\n").send(b"GET /../x HTTP/1.1\r\nHost: h\r\n\r\n")
    a = run(t.packets)
    doc = json.loads("".join(report.document(a.totals(), a.findings, a.summaries)))
    assert doc["summary"]["total_packets"] == len(t.packets) and [x["analyzer_name"] for x in doc["analyzers"]] == ["TCP Reassembly", "DNS", "HTTP", "TLS", "modbus", "DNP3", "EtherNet/IP", "ARP"]
    first = doc["findings"][0]
    assert first["mitre_attack"][0] == {"id": "T1083", "name": "File and Directory Discovery", "tactic_id": "TA0007", "tactic_name": "Discovery", "reference": "https://attack.mitre.org/techniques/T1083/"}
    text = "\n".join(report.terminal(a.totals(), a.findings, a.summaries))
    assert "[Discovery]" in text and "(x5)" in text and "\x1b" not in text
    report.write_csv(a.findings, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out")).collect()
    assert len(back) == a.findings.count() and back[0].verdict == "LIKELY"
    assert report.escaped("a\\\x9b\n") == "a\\\\\\x9b\\n"
    s = spark.createDataFrame([("=1",), ("-x",), ("ok",)], "s string")
    assert [r[0] for r in s.select(report.neutral(s.s)).collect()] == ["'=1", "'-x", "ok"]


def test_grease_and_cipher_names(spark):
    df = spark.createDataFrame([([0x0A0A, 0x1A0A, 0x0035, 0xABCD],)], "c array<int>")
    r = df.select(tls.no_grease(df.c).alias("g"), tls.cipher_name(df.c[3]).alias("n")).first()
    assert r.g == [0x35, 0xABCD] and r.n == "0xabcd"
