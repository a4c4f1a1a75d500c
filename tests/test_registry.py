"""Analyzers of a user's own: registered, dispatched to, framed, detected and summed up like the built-in ones."""

import json
import sys

import build as b
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from packetloom.operators.findings import finding, rows
from packetloom.plans import analyzers
from packetloom.plans.analyze import Options, analyze
from packetloom.plans.summaries import json_row

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the tasks don't know this file


class Lines(analyzers.FramingAnalyzer):
    """Text lines of streams that begin with HELO: one row a line, a finding for each QUIT."""

    name, place, route = "lines", 40, "Lines"
    schema = "at long, sub int, ts long, line string"

    def classify(self, data, lower_port, upper_port):
        return data.startswith(b"HELO")

    def frame(self, chunks):
        held = {}
        for c in chunks:
            *whole, rest = (held.pop(c["direction"], b"") + c["data"]).split(b"\n")
            held[c["direction"]] = rest[:1000]
            for i, line in enumerate(whole):
                yield c["ip_idx"], 1000 * c["sub"] + i, c["ts"], line.decode()

    def detect(self, frames, options):
        what = finding("Anomaly", "Possible", "Low", F.concat(F.lit("said "), F.col("line")), F.array(F.col("line")), [], 1)
        return rows(frames, self.place, F.col("at") * 10**6 + F.col("sub"), F.col("ts"), [(F.col("line") == "QUIT", what)])

    def summary(self, frames, routed, dropped):
        return json_row(frames.agg(F.count("*").alias("lines")), self.place, "Lines", "lines")


class Big(analyzers.PacketAnalyzer):
    name, place = "big", 41

    def wants(self):
        return F.col("packet_len") > 100

    def summary(self, packets, found):
        return json_row(packets.agg(F.count("*").alias("n")), self.place, "Big", "n")


@pytest.fixture
def own():
    analyzers.register(Lines())
    analyzers.register(Big())
    yield
    analyzers.unregister("lines")
    analyzers.unregister("big")


def test_a_foreign_analyzer_runs_beside_the_others(spark, tmp_path, own):
    t = b.Talk(cport=1234, sport=4321).send(b"HELO me\nNO").send(b"OP\nQUIT\n").send(b"BYE\nhalf", client=False).close()
    h = b.Talk(cport=1235).send(b"GET /../x HTTP/1.1\r\nHost: h\r\nUser-Agent: u\r\n\r\n" + b"x" * 80).close()
    (tmp_path / "x.pcap").write_bytes(b.pcap([*t.packets, *h.packets]))
    out = analyze(spark, str(tmp_path), options=Options(analyzers=("http", "lines", "big")))
    assert [(r.stage, r.summary, r.evidence) for r in out.findings.where("stage = 40").collect()] == [(40, "said QUIT", ["QUIT"])]
    assert out.findings.where("stage = 2").count() >= 1
    by = {r.analyzer_name: (r.place, r.packets_analyzed, json.loads(r.detail)) for r in out.summaries.collect()}
    assert by["Lines"] == (40, 4, {"lines": 4}) and by["Big"] == (41, 1, {"n": 1}) and by["HTTP"][1] == 0 and by["TCP Reassembly"][2]["unclassified_flows"] == 0
    without = analyze(spark, str(tmp_path), options=Options(analyzers=("http",)))
    assert json.loads(without.summaries.where("place = 0").first().detail)["unclassified_flows"] == 1


def test_names_and_places(own):
    with pytest.raises(ValueError, match="unknown"):
        Options(analyzers=("nothing",))
    with pytest.raises(ValueError, match="taken"):
        analyzers.register(type("Other", (Big,), {"name": "other"})())
    with pytest.raises(ValueError, match="taken"):
        analyzers.register(type("Other", (Big,), {"name": "http", "place": 99})())
