"""What an analyzer is, and the ones that are built in.

An analyzer says which packets or streams are its own, turns them into a table of what it
sees, and makes findings and a summary row of that table. The planner asks each registered
analyzer in the order of ``place``; one of a user's own is registered with :func:`register` and
asked for by its name in ``Options.analyzers``.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.operators import arp, dnp3, enip, http, modbus, summary, tls
from packetloom.operators.flows import KEY
from packetloom.operators.ordered import ordered_map

from .summaries import json_fields, json_row


class PacketAnalyzer(ABC):
    """An analyzer of single packets (:func:`operators.decode.packets`)."""

    #: The name by which it is asked for, and its place among summaries.
    name: str
    place: int

    def wants(self) -> Column:
        """Whether a packet is its own."""
        return F.lit(True)

    def detect(self, packets: DataFrame, options: Any) -> DataFrame | None:
        """Findings (``findings.COLUMNS``) in its packets; they are written before the summary is made."""
        return None

    @abstractmethod
    def summary(self, packets: DataFrame, found: DataFrame | None) -> DataFrame:
        """A row of place, analyzer_name, packets_analyzed and detail, a JSON text."""


class StreamAnalyzer(ABC):
    """An analyzer of reassembled streams."""

    name: str
    place: int
    #: The protocol under which streams are dispatched to it.
    route: str

    def classify(self, data: bytes, lower_port: int, upper_port: int) -> bool:
        """Whether a stream that no built-in rule knows is its own, by one of its first chunks."""
        return False

    @abstractmethod
    def frames(self, routed: DataFrame) -> DataFrame:
        """What it sees in the chunks of all streams (:func:`operators.dispatch.dispatch`), of which it takes its route's."""

    @abstractmethod
    def detect(self, frames: DataFrame, options: Any) -> DataFrame:
        """Findings (``findings.COLUMNS``) in its frames."""

    @abstractmethod
    def summary(self, frames: DataFrame, routed: DataFrame, dropped: int) -> DataFrame:
        """A row of place, analyzer_name, packets_analyzed and detail; ``dropped``: findings beyond the cap."""


class FramingAnalyzer(StreamAnalyzer):
    """A stream analyzer whose frames come from a state machine over each instance's chunks, in order."""

    #: Columns that :meth:`frame` yields, behind those of the flow key and ``inst``.
    schema: str

    @abstractmethod
    def frame(self, chunks: Iterator[dict]) -> Iterable[tuple]:
        """Rows of ``schema``; a chunk has ip_idx, sub, ts, direction and data. What it keeps should be bounded."""

    def frames(self, routed: DataFrame) -> DataFrame:
        mine = routed.where(F.col("route") == self.route).select(*KEY, "inst", "ip_idx", "sub", "ts", "direction", "data")
        lead = "lower_key binary, lower_port int, upper_key binary, upper_port int, inst long, "
        return ordered_map(mine, [*KEY, "inst"], ["ip_idx", "sub"], lambda key, chunks: ((*key, *row) for row in self.frame(chunks)), lead + self.schema)


class Dns(PacketAnalyzer):
    name, place = "dns", 1

    def summary(self, packets, found):
        return json_row(summary.dns(packets), 1, "DNS", "dns_queries + dns_responses")


class Arp(PacketAnalyzer):
    name, place = "arp", 7

    def detect(self, packets, options):
        return arp.detect(packets, options.arp_spoof, options.arp_storm_rate)

    def summary(self, packets, found):
        return json_row(arp.counts(packets, found), 7, "ARP", "frames_analyzed")


class Http(StreamAnalyzer):
    name, place, route = "http", 2, "Http"

    def frames(self, routed):
        return http.messages(routed)

    def detect(self, frames, options):
        return http.detect(frames)

    def summary(self, frames, routed, dropped):
        uris = [r.uri for r in http.recent_uris(frames).orderBy("nth").collect()]  # twenty
        uris = F.array(*[F.lit(u) for u in uris]).cast("array<string>")
        return json_fields(http.counts(frames), 2, "HTTP", "transactions", ("transactions", "parse_errors", "non_http_flows", "poisoned_bytes_skipped"), ("methods", "status_codes", "user_agents"), {"hosts": "top_hosts"}, {"recent_uris": uris})


class Tls(StreamAnalyzer):
    name, place, route = "tls", 3, "Tls"

    def frames(self, routed):
        return tls.hellos(routed)

    def detect(self, frames, options):
        return tls.detect(frames)

    def summary(self, frames, routed, dropped):
        return json_fields(tls.counts(frames), 3, "TLS", "handshakes", ("handshakes", "parse_errors", "truncated_records", "handshake_reassembly_overflows", "buffer_saturation_drops"), ("ja3_hashes", "ja3s_hashes", "tls_versions", "cipher_suites"), {"snis": "top_snis"})


class Modbus(StreamAnalyzer):
    name, place, route = "modbus", 4, "Modbus"

    def frames(self, routed):
        return modbus.units(routed)

    def detect(self, frames, options):
        return modbus.detect(frames, options.modbus_write_burst, options.modbus_write_sustained)

    def summary(self, frames, routed, dropped):
        return json_fields(modbus.counts(frames), 4, "modbus", "pdu_count", ("pdu_count", "write_count", "exception_count", "parse_errors"), ("function_code_distribution",), lists={"dropped_findings": F.lit(dropped)})


class Dnp3(StreamAnalyzer):
    name, place, route = "dnp3", 5, "Dnp3"

    def frames(self, routed):
        return dnp3.frames(routed)

    def detect(self, frames, options):
        return dnp3.detect(frames, options.dnp3_direct_operate)

    def summary(self, frames, routed, dropped):
        return json_fields(dnp3.counts(frames, routed), 5, "DNP3", "total_frames", ("total_frames", "parse_errors", "flows_analyzed"), ("function_code_distribution", "control_operation_counts"))


class Enip(StreamAnalyzer):
    name, place, route = "enip", 6, "Enip"

    def frames(self, routed):
        return enip.frames(routed)

    def detect(self, frames, options):
        return enip.detect(frames, options.enip_write_burst, options.enip_error_burst)

    def summary(self, frames, routed, dropped):
        return json_fields(enip.counts(frames, routed), 6, "EtherNet/IP", "total_pdu_count", ("total_pdu_count", "parse_errors", "error_count", "write_count", "flows_analyzed"), ("command_distribution",), lists={"dropped_findings": F.lit(dropped)}, nested="enip_summary")


BUILT_IN = {a.name: a for a in (Dns(), Http(), Tls(), Modbus(), Dnp3(), Enip(), Arp())}
_REGISTRY: dict[str, PacketAnalyzer | StreamAnalyzer] = dict(BUILT_IN)


def register(analyzer: PacketAnalyzer | StreamAnalyzer) -> None:
    """Make an analyzer known by its name. Names of built-in analyzers and places of others can't be taken."""
    if analyzer.name in BUILT_IN or any(a.place == analyzer.place for n, a in _REGISTRY.items() if n != analyzer.name):
        raise ValueError(f"the name {analyzer.name} or the place {analyzer.place} is taken")
    _REGISTRY[analyzer.name] = analyzer


def unregister(name: str) -> None:
    if name not in BUILT_IN:
        _REGISTRY.pop(name, None)


def known() -> set[str]:
    return set(_REGISTRY)


def chosen(names: Iterable[str], kind: type) -> list:
    """The analyzers of a kind among ``names``, in order of place."""
    return sorted((_REGISTRY[n] for n in set(names) if isinstance(_REGISTRY[n], kind)), key=lambda a: a.place)
