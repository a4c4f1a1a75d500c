"""The analysis of captures as one plan: decode once, branch to the analyzers that are asked for."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators import decode, dispatch, flows, reassembly, summary
from packetloom.operators.findings import COLUMNS, LAST, capped, dropped, finding, rows
from packetloom.scratch import stage
from packetloom.sources.capture import captures, read_captures

from .analyzers import BUILT_IN, PacketAnalyzer, StreamAnalyzer, chosen, known
from .summaries import json_row

STREAMS = tuple(n for n, a in BUILT_IN.items() if isinstance(a, StreamAnalyzer))
ANALYZERS = tuple(BUILT_IN)
# What the report says of segments beyond the limit.
SEGMENT_LIMIT_EVIDENCE = ("Segment count limit prevents BTreeMap overhead explosion", "May indicate segmentation-based evasion attempt")


@dataclass(frozen=True)
class Options:
    """What to analyze, and the thresholds."""

    analyzers: tuple[str, ...] = ANALYZERS
    reassemble: bool = True
    flow: flows.FlowConfig = field(default_factory=flows.FlowConfig)
    modbus_write_burst: int = 20
    modbus_write_sustained: int = 10
    dnp3_direct_operate: int = 10
    enip_write_burst: int = 50
    enip_error_burst: int = 5
    arp_spoof: int = 3
    arp_storm_rate: int = 50

    def __post_init__(self):
        for name in ("modbus_write_burst", "modbus_write_sustained", "arp_spoof", "arp_storm_rate"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if unknown := set(self.analyzers) - known():
            raise ValueError(f"unknown analyzers: {', '.join(sorted(unknown))}")


@dataclass
class Analysis:
    """Tables of an analysis, written in the shared folder; ``summaries``: place, analyzer_name, packets_analyzed, detail as JSON."""

    files: DataFrame | None
    packets: DataFrame
    findings: DataFrame
    summaries: DataFrame
    flows: DataFrame | None = None

    def totals(self) -> dict:
        """The capture summary as a small dictionary: what the driver needs for a report."""
        out = summary.totals(self.packets, malformed_arp_skipped=False).first().asDict()
        out["unique_hosts"] = summary.hosts(self.packets).count()
        out["protocols"] = {r.protocol: r.packets for r in summary.protocols(self.packets).collect()}
        out["services"] = {r.service: r.packets for r in summary.services(self.packets).collect()}
        return out


def analyze_packets(packets: DataFrame, options: Options = Options()) -> Analysis:
    """The analysis of decoded packets (:func:`decode.packets`). Branches that aren't asked for are never built.

    Packets, streams, what each analyzer sees and findings are written as tables and read
    again, so every plan is short, each step runs once, and a lost executor costs one
    read.
    """
    on = options.analyzers
    packets = stage(packets.drop("data"), "packets")
    found: list[DataFrame] = []
    sums: list[DataFrame] = []
    for analyzer in chosen(on, PacketAnalyzer):
        mine = packets.where(analyzer.wants())
        own = analyzer.detect(mine, options)
        if own is not None:
            own = stage(own, f"{analyzer.name}-findings")
            found.append(own)
        sums.append(analyzer.summary(mine, own))
    later, flow_rows = [], None
    if options.reassemble:
        flow_rows = _streams(packets, options, found, later)
    spark = packets.sparkSession
    all_ = spark.createDataFrame([], FINDINGS)
    for f in found:
        all_ = all_.unionByName(f)
    all_ = stage(all_, "findings")
    lost = dropped(all_)
    sums += [build(lost) for build in later]
    summaries = spark.createDataFrame([], "place int, analyzer_name string, packets_analyzed long, detail string")
    for s in sums:
        summaries = summaries.unionByName(s)
    return Analysis(None, packets, stage(capped(all_), "report"), stage(summaries, "summaries"), flow_rows)


FINDINGS = "stage int, at long, sub int, category string, verdict string, confidence string, summary string, evidence array<string>, mitre_techniques array<string>, source_ip string, ts timestamp, direction string"


def _streams(packets: DataFrame, options: Options, found: list[DataFrame], later: list) -> DataFrame:
    """Add findings to ``found``, and to ``later`` functions from the dropped findings of each stage to a summary row."""
    mine = chosen(options.analyzers, StreamAnalyzer)
    config = replace(options.flow, routes=tuple((a.route, a.classify) for a in mine if a.name not in BUILT_IN))
    indexed = flows.ip_index(packets)
    tcp = flows.instances(indexed, config)
    # Payloads go into the streams; what the flows are counted by stays behind.
    made = stage(reassembly.reassemble(tcp, config), "streams")
    end = packets.where("kind = 'ip'").agg(F.max(F.greatest("ts", F.lit(0))).alias("clock"), F.count_if(F.col("protocol") != "Tcp").alias("packets_skipped_non_tcp"), F.count("*").alias("packets_processed")).first()
    flow_rows = stage(flows.flows(tcp, end["clock"] or 0, end["packets_processed"], config), "flows")

    text = [c for c in COLUMNS if c not in ("stage", "at", "ts")]
    own = made.where("what = 'finding'").select(F.lit(1).alias("stage"), F.col("ip_idx").alias("at"), *text, F.timestamp_seconds("ts").alias("ts")).select(*COLUMNS)
    totals = stage(reassembly.stats(made), "stream-totals")
    limit = F.col("segments_segment_limit")
    closing = finding("Anomaly", "Inconclusive", "Medium", F.concat(limit.cast("string"), F.lit(" segment"), F.when(limit == 1, "").otherwise("s"), F.lit(" dropped due to per-flow segment count limit")), F.array(*[F.lit(x) for x in SEGMENT_LIMIT_EVIDENCE]), [], 0)
    found.append(own.unionByName(rows(totals, 1, F.lit(LAST), F.lit(None).cast("long"), [(limit > 0, closing)])))

    routed = dispatch.dispatch(reassembly.chunks(made))
    expired = flow_rows.agg(F.count_if("expired").alias("n")).first()["n"]
    wide = totals.withColumns({"flows_expired": F.lit(expired), "packets_skipped_non_tcp": F.lit(end["packets_skipped_non_tcp"]), "packets_processed": F.lit(end["packets_processed"]), "evictions": F.lit(0)})
    if not mine:
        wide = wide.drop("unclassified_flows")
    later.append(lambda lost: json_row(wide.withColumn("dropped_findings", F.lit(lost[1])), 0, "TCP Reassembly", "packets_tcp"))

    for analyzer in mine:
        frames = stage(analyzer.frames(routed), analyzer.name)
        found.append(analyzer.detect(frames, options))
        later.append(lambda lost, a=analyzer, frames=frames: a.summary(frames, routed, lost.get(a.place, 0)))
    return flow_rows


def analyze(spark: SparkSession, *targets: str, options: Options = Options()) -> Analysis:
    """The analysis of capture files and folders. State runs on over all files, in order."""
    raw = read_captures(spark, *targets)
    out = analyze_packets(decode.packets(raw), options)
    out.files = captures(raw)
    return out
