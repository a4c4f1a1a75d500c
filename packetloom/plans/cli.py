"""``python -m packetloom.plans.cli analyze|summary TARGET...``: reports of capture files."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Iterable
from contextlib import nullcontext
from itertools import chain

from pyspark.sql import SparkSession

from packetloom.operators import decode, report, summary
from packetloom.operators.flows import FlowConfig
from packetloom.scratch import stage
from packetloom.sources.capture import captures, read_captures

from .analyze import ANALYZERS, FINDINGS, STREAMS, Options, analyze


def _between(low: int, high: int):
    def number(text: str) -> int:
        n = int(text)
        if not low <= n <= high:
            raise argparse.ArgumentTypeError(f"not between {low} and {high}")
        return n

    return number


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="packetloom")
    parts = out.add_subparsers(dest="command", required=True)
    for name in ("analyze", "summary"):
        p = parts.add_parser(name)
        p.add_argument("targets", nargs="+")
        form = p.add_mutually_exclusive_group()
        form.add_argument("--json", nargs="?", const="-", metavar="FILE")
        form.add_argument("--csv", nargs="?", const="-", metavar="FILE")
        form.add_argument("--output-format", choices=("json", "csv"))
    p = parts.choices["summary"]
    p.add_argument("--hosts", action="store_true")
    p = parts.choices["analyze"]
    p.add_argument("--all", action="store_true")
    for name in ANALYZERS:
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("--reassemble", action="store_true", help="follow TCP streams even where no analyzer needs them")
    p.add_argument("--no-reassemble", action="store_true")
    p.add_argument("--flat", action="store_true", help="findings in order of emission")
    p.add_argument("--no-collapse", action="store_true")
    d = FlowConfig()
    p.add_argument("--overlap-threshold", type=_between(0, 255), default=d.overlap_threshold)
    p.add_argument("--small-segment-threshold", type=_between(0, 2048), default=d.small_threshold)
    p.add_argument("--small-segment-max-bytes", type=_between(0, 2048), default=d.small_bytes)
    p.add_argument("--small-segment-ignore-ports", type=_ports, default=d.small_ignore_ports, metavar="PORT,...")
    p.add_argument("--out-of-window-threshold", type=_between(0, 2**31), default=d.out_of_window_threshold)
    p.add_argument("--flow-timeout", type=_between(1, 2**31), default=d.timeout)
    p.add_argument("--reassembly-depth", type=_between(1, 4096), default=d.max_depth >> 20, metavar="MB")
    p.add_argument("--reassembly-memcap", type=_between(1, 2**31), metavar="MB", help="accepted, without effect: streams are bounded by depth, window and segments in each task")
    for field in THRESHOLDS:
        p.add_argument(f"--{field.replace('_', '-')}-threshold", dest=field, type=_between(0, 2**31), default=getattr(Options(), field))
    return out


THRESHOLDS = ("modbus_write_burst", "modbus_write_sustained", "dnp3_direct_operate", "enip_write_burst", "enip_error_burst", "arp_spoof", "arp_storm_rate")


def _ports(text: str) -> tuple[int, ...]:
    return tuple(_between(0, 65_535)(x) for x in text.split(",") if x)


def options(args: argparse.Namespace) -> Options:
    """Streams are followed where an analyzer of them or ``--reassemble`` asks for it and ``--no-reassemble`` doesn't forbid it."""
    wanted = tuple(a for a in ANALYZERS if args.all or getattr(args, a))
    flow = FlowConfig(
        timeout=args.flow_timeout, max_depth=args.reassembly_depth << 20, overlap_threshold=args.overlap_threshold, small_threshold=args.small_segment_threshold,
        small_bytes=args.small_segment_max_bytes, small_ignore_ports=args.small_segment_ignore_ports, out_of_window_threshold=args.out_of_window_threshold,
    )
    needed = args.reassemble or bool(set(STREAMS) & set(wanted))
    return Options(analyzers=wanted, reassemble=needed and not args.no_reassemble, flow=flow, **{f: getattr(args, f) for f in THRESHOLDS})


# What is said of analyzers that can't run without streams.
WARNINGS = (
    (("http", "tls"), "Warning: --http/--tls require TCP reassembly, but --no-reassemble is set. Stream analysis will be skipped."),
    (("modbus",), "WARNING: --modbus requires stream reassembly; ignoring --modbus (pass --reassemble or omit --no-reassemble)"),
    (("dnp3",), "WARNING: --dnp3 requires stream reassembly; ignoring --dnp3 (pass --reassemble or omit --no-reassemble)"),
    (("enip",), "--enip requires TCP reassembly; ENIP analysis disabled"),
)


def warnings(args: argparse.Namespace) -> list[str]:
    on = options(args).analyzers
    return [text for names, text in WARNINGS if args.no_reassemble and set(names) & set(on)]


def zero_packets(path: str, is_pcapng: bool, skipped: int, obsolete: int) -> str:
    """The notice of a file without packets; ``skipped`` counts obsolete blocks too."""
    text = f"notice: {path}: 0 packets read from {'pcapng file' if is_pcapng else 'pcap file'}"
    if skipped > obsolete:
        text += f" ({skipped - obsolete} block(s) skipped as unsupported)"
    if obsolete:
        text += f" (includes {obsolete} obsolete Packet Block(s) whose data was not analyzed; re-save with mergecap)"
    return text


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    as_json, as_csv = args.json or args.output_format == "json", args.csv or args.output_format == "csv"
    target = next((x for x in (args.json, args.csv) if x and x != "-"), None)
    lines: Iterable[str]
    if args.command == "summary":
        raw = read_captures(spark, *args.targets)
        packets, files = stage(decode.packets(raw).drop("data", "payload"), "summary-packets"), captures(raw)
        totals = summary.totals(packets).first().asDict() | {"unique_hosts": summary.hosts(packets).count()}
        totals |= {"protocols": {r.protocol: r.packets for r in summary.protocols(packets).collect()}, "services": {r.service: r.packets for r in summary.services(packets).collect()}}
        nothing = spark.createDataFrame([], FINDINGS)
        if as_csv:  # a summary has no findings: the header alone
            lines = report.csv_text(nothing)
        elif as_json:
            lines = report.document(totals, nothing, spark.createDataFrame([], "place int, analyzer_name string, packets_analyzed long, detail string"))
        else:
            hosts = (f"  {r.host}" for r in summary.hosts(packets).orderBy("host_key").toLocalIterator()) if args.hosts else ()
            lines = chain(report.totals_lines(totals), ["HOSTS"] if args.hosts else [], hosts)
    else:
        for text in warnings(args):
            print(text, file=sys.stderr)
        found = analyze(spark, *args.targets, options=options(args))
        files = found.files
        if as_csv and target:
            report.write_csv(found.findings, target)
            lines, target = (), None
        elif as_csv:
            lines = report.csv_text(found.findings)
        elif as_json and target:
            report.write_json(found.totals(), found.findings, found.summaries, os.path.abspath(target) if "://" not in target else target)
            lines, target = (), None
        elif as_json:
            lines = report.document(found.totals(), found.findings, found.summaries)
        else:
            lines = report.terminal(found.totals(), found.findings, found.summaries, not args.flat, not args.no_collapse)
    with open(target, "w", encoding="utf-8") if target else nullcontext(sys.stdout) as out:
        for line in lines:
            print(line, file=out, end="" if as_json else "\n")
    bad = files.where("error IS NOT NULL").select("path", "error").orderBy("path").collect()
    for r in bad:
        print(f"{r.path}: {r.error}", file=sys.stderr)
    for r in files.where("error IS NULL AND packets = 0").orderBy("path").collect():
        print(zero_packets(r.path, r.is_pcapng, r.skipped_blocks, r.opb_skipped), file=sys.stderr)
    return int(bool(bad))


if __name__ == "__main__":
    sys.exit(main())
