"""TCP streams from the packets of each flow instance: the first bytes to arrive win.

The packets of an instance pass through a state machine in order. What it holds of a
direction is bounded by the configured depth, window and number of segments. It leaves
chunks of stream data, findings, and one row of counters.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dispatch import ATTEMPTS, classify_bytes
from .flows import KEY, FlowConfig
from .ordered import ordered_map

CLIENT, SERVER = "ClientToServer", "ServerToClient"
SCHEMA = (
    "lower_key binary, lower_port int, upper_key binary, upper_port int, inst long, flow string, what string, ip_idx long, sub int, ts long, direction string,"
    " offset long, data binary, category string, verdict string, confidence string, summary string, evidence array<string>, mitre_techniques array<string>,"
    " source_ip string, stats map<string,long>, route string"
)


class Stream:
    """One direction: bytes that wait for those before them, as pieces that don't overlap."""

    def __init__(self, config: FlowConfig):
        self.config, self.isn = config, None
        self.next = 0  # offset of the first byte not yet delivered; 1 follows the initial number
        self.delivered = self.waiting = 0
        self.starts: list[int] = []
        self.pieces: dict[int, bytes] = {}
        self.overlaps = self.outside = self.small_run = 0
        self.told: set[str] = set()

    def begin(self, isn: int) -> None:
        if self.isn is None:
            self.isn, self.next = isn & 0xFFFFFFFF, 1

    def offset(self, seq: int) -> int:
        return (seq - self.isn) & 0xFFFFFFFF

    def add(self, seq: int, data: bytes) -> tuple[str, bool]:
        """What became of a segment, and whether it left any byte."""
        c, at = self.config, self.offset(seq)
        if at + len(data) < self.next or at > self.next + c.max_window:
            self.outside += 1
            return "outside", False
        if len(self.starts) >= c.max_segments:
            return "limit", False
        room = c.max_depth - self.delivered - self.waiting
        if c.max_depth <= self.delivered or room <= 0:
            return "depth", False
        cut = len(data) > room
        data = data[:room]
        end = at + len(data)

        touching = self._touching(at, end)
        if not touching:
            self._put(at, data)
            return ("cut" if cut else "new"), True
        self.overlaps += 1
        differs = any(self._shared(s, at, data) for s in touching)
        gaps, cursor = [], at
        for s in touching:
            if cursor < s:
                gaps.append((cursor, s))
            cursor = max(cursor, s + len(self.pieces[s]))
        if cursor < end:
            gaps.append((cursor, end))
        if not gaps:
            return ("conflict" if differs else "duplicate"), False
        left = False
        for a, b in gaps:
            if len(self.starts) >= c.max_segments:
                return "limit", left
            self._put(a, data[a - at : b - at])
            left = True
        return ("cut" if cut else "overlap"), True

    def _touching(self, at: int, end: int) -> list[int]:
        """The starts of held pieces with bytes in [at, end). Pieces don't overlap, so only the one before ``at`` can reach into it."""
        i = max(bisect_right(self.starts, at) - 1, 0)
        if i < len(self.starts) and self.starts[i] + len(self.pieces[self.starts[i]]) <= at:
            i += 1
        return self.starts[i : bisect_left(self.starts, end, i)]

    def _shared(self, s: int, at: int, data: bytes) -> bool:
        """Whether a held piece and the new data differ where both have bytes."""
        held = self.pieces[s]
        a, b = max(s, at), min(s + len(held), at + len(data))
        return held[a - s : b - s] != data[a - at : b - at]

    def _put(self, at: int, data: bytes) -> None:
        self.starts.insert(bisect_right(self.starts, at), at)
        self.pieces[at] = data
        self.waiting += len(data)

    def ready(self) -> Iterator[tuple[int, bytes]]:
        while (data := self.pieces.pop(self.next, None)) is not None:
            self.starts.pop(bisect_left(self.starts, self.next))
            at, self.next = self.next, self.next + len(data)
            self.waiting -= len(data)
            self.delivered += len(data)
            yield at, data


#: Counters that an outcome of :meth:`Stream.add` raises.
RAISES = {
    "new": ("segments_inserted",),
    "duplicate": ("segments_duplicates",),
    "overlap": ("segments_overlaps", "segments_inserted"),
    "conflict": ("segments_overlaps",),
    "cut": ("segments_inserted",),
    "depth": ("segments_depth_exceeded",),
    "limit": ("segments_segment_limit",),
    "outside": ("segments_out_of_window",),
}


class Flow:
    """One flow instance: its two streams and what is counted. It ends with a reset, two FINs, or from outside."""

    def __init__(self, config: FlowConfig):
        self.config = config
        self.streams = {CLIENT: Stream(config), SERVER: Stream(config)}
        self.initiator, self.synced, self.fins, self.reset = None, False, 0, False
        self.stats: Counter = Counter()
        self.route, self.looks = None, 0

    @property
    def closed(self) -> bool:
        return self.reset or self.fins >= 2

    def packet(self, p: dict) -> Iterator[dict]:
        """Chunks and findings that a packet brings, in order."""
        stats, ports = self.stats, (p["lower_port"], p["upper_port"])
        stats["packets_tcp"] += 1
        if p["syn"]:
            if self.initiator is None:
                self.initiator = p["from_lower"] != p["ack"]  # of a SYN+ACK the other end
            self.streams[self._way(p)].begin(p["seq"])
            self.synced = True
        if p["rst"]:
            self.reset = True
            return
        if p["fin"]:
            self.fins += 1
        data = p["payload"]
        if not data:
            return
        if not self.synced and self.fins < 2:
            self.synced, stats["flows_partial"] = True, 1
            if self.initiator is None:
                self.initiator = p["from_lower"]
        direction = self._way(p)
        own = self.streams[direction]
        own.begin(p["seq"] - 1)
        outcome, left = own.add(p["seq"], data)
        if outcome not in ("outside", "limit", "depth"):
            own.small_run = own.small_run + 1 if len(data) < self.config.small_bytes else 0
        for name in RAISES[outcome]:
            stats[name] += 1
        if outcome == "limit" and left:
            stats["segments_overlaps"] += 1
            stats["segments_inserted"] += 1
        c = self.config
        if outcome in ("conflict", "cut") or own.overlaps > c.overlap_threshold or own.small_run > c.small_threshold or own.outside > c.out_of_window_threshold:
            for f in _findings(c, own, outcome, p, direction, ports):
                yield f | {"p": p, "what": "finding"}
        for at, chunk in own.ready():
            stats["bytes_reassembled"] += len(chunk)
            if self.route is None and self.looks < ATTEMPTS:
                self.route, self.looks = classify_bytes(chunk, *ports, self.config.routes), self.looks + 1
            yield {"what": "chunk", "p": p, "direction": direction, "offset": at, "data": chunk, "route": self.route}

    def end(self, last: dict) -> dict:
        """The row of counters, at the instance's last packet."""
        stats = self.stats
        stats["flows_rst"] += self.reset
        stats["flows_fin"] += self.fins >= 2 and not self.reset
        stats["flows_total"] += 1
        stats["unclassified_flows"] += self.route is None
        return {"what": "stats", "p": last, "stats": {k: v for k, v in stats.items() if v}}

    def _way(self, p: dict) -> str:
        return CLIENT if self.initiator == p["from_lower"] else SERVER


def _instance(config: FlowConfig, rows: Iterator[dict]) -> Iterator[dict]:
    """Chunks, findings and counters of one flow instance, in order."""
    flow, last = Flow(config), {}
    for last in rows:
        yield from flow.packet(last)
        if flow.reset:
            break
    yield flow.end(last)


def _findings(config: FlowConfig, own: Stream, outcome: str, p: dict, direction: str, ports: tuple[int, ...]) -> Iterator[dict]:
    flow = p["flow"]
    base = {"category": "Anomaly", "source_ip": p["src_ip"], "mitre_techniques": [], "verdict": "Inconclusive"}
    if outcome == "conflict":
        yield base | {"verdict": "Likely", "confidence": "High", "summary": f"Conflicting TCP segment overlap on flow {flow}", "evidence": ["Retransmitted segment contains different data"], "mitre_techniques": ["T1036"], "direction": None}
    if outcome == "cut":
        yield base | {"confidence": "Low", "summary": f"Stream depth exceeded on flow {flow}", "evidence": [f"Max depth {config.max_depth} bytes reached"], "direction": None}
    if own.overlaps > config.overlap_threshold and "overlaps" not in own.told:
        own.told.add("overlaps")
        yield base | {"verdict": "Likely", "confidence": "Medium", "summary": f"Excessive segment overlaps ({own.overlaps}) on flow {flow}", "evidence": ["Possible evasion attempt"], "mitre_techniques": ["T1036"], "direction": direction}
    if own.small_run > config.small_threshold and "small" not in own.told and not set(ports) & set(config.small_ignore_ports):
        own.told.add("small")
        yield base | {"confidence": "Medium", "summary": f"Excessive consecutive small segments ({own.small_run}) on flow {flow}", "evidence": ["Long unbroken run of undersized TCP segments; possible segmentation-based IDS evasion"], "direction": direction}
    if own.outside > config.out_of_window_threshold and "outside" not in own.told:
        own.told.add("outside")
        yield base | {"confidence": "Low", "summary": f"Excessive out-of-window segments ({own.outside}) on flow {flow}", "evidence": [f"max_receive_window={config.max_window} bytes; possible misconfiguration, evasion, or capture corruption"], "direction": direction}


def _numbered(config: FlowConfig, rows: Iterator[dict]) -> Iterator[tuple[int, dict]]:
    """Packets of a key with the number of their instance, by the rules of :func:`flows.instances`."""
    nth, fins, last = -1, 0, None
    for p in rows:
        begins = last is None or last["rst"]
        if not begins:
            swept = p["ip_idx"] // config.sweep_packets * config.sweep_packets
            begins = p["clock"] > last["clock"] and p["clock"] - last["ts"] > config.timeout or swept > last["ip_idx"] and swept - last["ip_idx"] > config.idle_packets
        if begins or fins >= 2:
            nth, fins = nth + 1, 0
        fins += p["fin"] and not p["rst"]
        last = p
        yield nth, p


def reassemble(tcp: DataFrame, config: FlowConfig = FlowConfig(), only: str | None = None) -> DataFrame:
    """Rows of :data:`SCHEMA`: chunk, finding or stats; ``only``: the kind that is asked for, so that no others leave the pass.

    ``tcp``: packets of :func:`flows.instances`, whose shuffle and order are used again, or those of
    :func:`flows.keyed` with ip_idx and clock, whose instances are told apart in the same pass.
    """

    def rows_of(key: tuple, nth: int, made: Iterator[dict]) -> Iterator[tuple]:
        for sub, m in enumerate(made):
            if only is not None and m["what"] != only:
                continue
            p = m["p"]
            yield (
                *key, nth, p["flow"], m["what"], p["ip_idx"], sub, p["ts"], m.get("direction"), m.get("offset"), m.get("data"), m.get("category"), m.get("verdict"),
                m.get("confidence"), m.get("summary"), m.get("evidence"), m.get("mitre_techniques"), m.get("source_ip"), list(m["stats"].items()) if "stats" in m else None, m.get("route"),
            )

    def known(key: tuple, rows: Iterator[dict]) -> Iterator[tuple]:
        return rows_of(key[:-1], key[-1], _instance(config, rows))

    def told(key: tuple, rows: Iterator[dict]) -> Iterator[tuple]:
        for nth, own in groupby(_numbered(config, rows), key=lambda x: x[0]):
            yield from rows_of(key, nth, _instance(config, (p for _, p in own)))

    needed = ["ip_idx", "flow", "ts", "src_ip", "from_lower", "seq", "syn", "ack", "fin", "rst", "payload"]
    if "inst" not in tcp.columns:
        return ordered_map(tcp.select(*KEY, "clock", *needed), KEY, ["ip_idx"], told, SCHEMA)
    # Behind the windows of the instances this one needs no shuffle and no sort; behind anything
    # else Spark adds them. Instances of a key follow one another.
    placed = tcp.select(*KEY, "inst", *needed).withColumn("_nth", F.row_number().over(Window.partitionBy(*KEY).orderBy("ip_idx")))
    return ordered_map(placed, [*KEY, "inst"], ["ip_idx"], known, SCHEMA, placed=True)


STATS = ["flows_partial", "flows_fin", "flows_rst", "segments_inserted", "segments_duplicates", "segments_overlaps", "segments_out_of_window", "segments_segment_limit", "segments_depth_exceeded", "bytes_reassembled", "flows_total", "packets_tcp", "unclassified_flows"]


def stats(reassembled: DataFrame) -> DataFrame:
    """One row with the sums of all counters."""
    rows = reassembled.where("what = 'stats'")
    value = lambda c: F.coalesce(F.sum(F.try_element_at("stats", F.lit(c))), F.lit(0)).alias(c)
    return rows.agg(*[value(c) for c in STATS]).withColumn("flows_completed", F.col("flows_fin") + F.col("flows_rst"))


def chunks(reassembled: DataFrame) -> DataFrame:
    return reassembled.where("what = 'chunk'").select(*KEY, "inst", "flow", "ip_idx", "sub", "ts", "direction", "offset", "data", "route")
