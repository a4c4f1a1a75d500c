"""Caps, enrichment, summary keys and the command line."""

import json
import struct

import build as b
import pytest
from pyspark.sql import functions as F

from packetloom.operators import findings, http, mitre, report
from packetloom.plans import analyze, cli


def made(spark, n, stage=4):
    """``n`` findings of a stage, and one at the end."""
    ids = spark.range(n).select(F.lit(stage).alias("stage"), F.col("id").alias("at"))
    return ids.unionByName(spark.createDataFrame([(stage, findings.LAST)], "stage int, at long")).withColumn("sub", F.lit(0))


def test_caps_keep_the_first_findings_and_the_closing_one(spark):
    found = made(spark, 50).unionByName(made(spark, 7, 1)).unionByName(made(spark, 60, 2))
    got = findings.capped(found, 20).groupBy("stage").agg(F.count("*").alias("n"), F.max(F.when(F.col("at") != findings.LAST, F.col("at"))).alias("last")).collect()
    assert {(r.stage, r.n, r["last"]) for r in got} == {(4, 21, 19), (1, 8, 6), (2, 61, 59)}
    assert findings.dropped(found, 20) == {1: 0, 4: 30, 5: 0, 6: 0}


def test_techniques_behind_a_shuffle_are_their_own(spark):
    """Every finding gets the techniques that it names, after an aggregation dealt over many tasks."""
    known = [t for t, _, _ in mitre.TECHNIQUES]
    pick = F.element_at(F.array(*[F.lit(t) for t in known]), (F.col("k") % len(known) + 1).cast("int"))
    rows = spark.range(30_000).groupBy((F.col("id") % 20_000).alias("k")).agg(F.count("*").alias("n")).withColumn("mitre_techniques", F.array(pick, F.lit("T9999")))
    rich = mitre.enrich(rows)
    wrong = rich.where((F.size("mitre_attack") != 2) | (F.col("mitre_attack")[0]["id"] != F.col("mitre_techniques")[0]) | F.col("mitre_attack")[0]["name"].isNull() | F.col("mitre_attack")[1]["name"].isNotNull())
    assert rich.count() == 20_000 and wrong.count() == 0
    assert mitre.by_tactic(rows).where("tactic_name = 'Uncategorized'").count() == 0


def test_plans_stay_small(spark, tmp_path):
    t = b.Talk().send(b"GET / HTTP/1.1\r\nHost: h\r\n\r\n").close()
    (tmp_path / "a.pcap").write_bytes(b.pcap(t.packets))
    a = analyze.analyze(spark, str(tmp_path))
    for df in (a.findings, a.summaries, a.packets, a.flows):
        assert len(df._jdf.queryExecution().toString()) < 20_000


def test_keys_beyond_the_first_ones_are_not_told_apart(spark):
    values = spark.createDataFrame([("f", v, i) for i, v in enumerate("abcabdae")], "field string, value string, at long")
    assert {(r.value, r.n) for r in http.first_keys(values, ["at"], 3).collect()} == {("a", 3), ("b", 2), ("c", 1)}


def run(capsys, *argv):
    code = cli.main([str(a) for a in argv])
    got = capsys.readouterr()
    return code, got.out, got.err


@pytest.fixture
def captures(tmp_path):
    """A capture with one request, in a folder, and an empty one in another."""
    t = b.Talk().send(b'GET /../"x" HTTP/1.1\r\nHost: h\r\n\r\n').close()
    for name, data in (("full", b.pcap(t.packets)), ("none", b.pcap([]))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.pcap").write_bytes(data)
    (tmp_path / "none" / "b.pcap").write_bytes(b.section() + b.interface() + b.block(5, b"1234") + b.block(2, b"1234"))
    (tmp_path / "none" / "c.pcap").write_bytes(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 99))
    return tmp_path


def test_command_line_analyze(spark, captures, capsys):
    code, out, err = run(capsys, "analyze", captures / "full", "--http", "--json")
    doc = json.loads(out)
    assert code == 0 and doc["mitre_domain"] == "ics-attack" and [f["summary"] for f in doc["findings"]] == ['Path traversal in URI: /../"x"'] and doc["findings"][0]["mitre_attack"][0]["id"] == "T1083"
    assert [a["analyzer_name"] for a in doc["analyzers"]] == ["TCP Reassembly", "HTTP"]
    code, out, _ = run(capsys, "analyze", "--http", "--output-format", "csv", captures / "full")
    lines = out.splitlines()
    assert lines[0].startswith('"category","verdict"') and len(lines) == 2 and '"Path traversal in URI: /../""x"""' in lines[1]
    code, out, err = run(capsys, "analyze", "--http", "--modbus", "--no-reassemble", captures / "full", captures / "none")
    assert code == 1 and "ignoring --modbus" in err and "--http/--tls require" in err and "FINDINGS" in out
    assert "a.pcap: 0 packets read from pcap file" in err and "b.pcap: 0 packets read from pcapng file (1 block(s) skipped as unsupported) (includes 1 obsolete" in err and "link type 99" in err


def test_command_line_summary(spark, captures, capsys):
    code, out, _ = run(capsys, "summary", "--hosts", captures / "full")
    assert code == 0 and "  10.0.0.1" in out and "HTTP: " in out
    assert run(capsys, "summary", captures / "full", "--csv")[1].startswith('"category"')
    assert json.loads(run(capsys, "summary", "--output-format", "json", captures / "full")[1])["summary"]["total_packets"] == 6


def test_options_of_the_command_line():
    args = cli.parser().parse_args(["analyze", "--arp", "--small-segment-max-bytes", "5", "--small-segment-ignore-ports", "1,2", "--out-of-window-threshold", "7", "x"])
    o = cli.options(args)
    assert not o.reassemble and (o.flow.small_bytes, o.flow.small_ignore_ports, o.flow.out_of_window_threshold) == (5, (1, 2), 7)
    assert cli.options(cli.parser().parse_args(["analyze", "--reassemble", "x"])).reassemble
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["analyze", "--small-segment-max-bytes", "2049", "x"])


def test_a_large_report_is_one_json_file(spark, tmp_path):
    """Many findings from many tasks, in order, and none: the file is what the pieces of the document give."""
    found = spark.range(250_000).select(
        F.lit(2).alias("stage"), (250_000 - F.col("id")).alias("at"), F.lit(0).alias("sub"), F.lit("Anomaly").alias("category"), F.lit("Likely").alias("verdict"), F.lit("High").alias("confidence"),
        F.concat(F.lit('f "\n é '), F.col("id").cast("string")).alias("summary"), F.array(F.lit("e")).alias("evidence"), F.array(F.lit("T0814")).alias("mitre_techniques"), F.lit("1.2.3.4").alias("source_ip"),
        F.timestamp_seconds(F.col("id")).alias("ts"), F.lit(None).cast("string").alias("direction"),
    )
    sums = spark.createDataFrame([(1, "HTTP", 5, '{"x": [1]}')], "place int, analyzer_name string, packets_analyzed long, detail string")
    path = tmp_path / "report.json"
    report.write_json({"total_packets": 3, "protocols": {"Tcp": 1}}, found, sums, str(path))
    doc = json.loads(path.read_text(encoding="utf-8"))
    assert [f["summary"] for f in doc["findings"][:2]] == ['f "\n é 249999', 'f "\n é 249998'] and len(doc["findings"]) == 250_000
    assert doc["summary"]["protocols"] == {"Tcp": 1} and doc["analyzers"][0]["detail"] == {"x": [1]} and list(doc)[-1] == "mitre_attack_version"
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["report.json"]
    few = found.limit(3)
    for own in (few, found.limit(0)):
        report.write_json({}, own, sums, str(path))
        assert json.loads(path.read_text(encoding="utf-8")) == json.loads("".join(report.document({}, own, sums)))
