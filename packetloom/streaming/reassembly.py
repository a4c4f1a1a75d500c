"""TCP reassembly of a stream of packets, by the state machine of the batch operator.

A key's state is a row of numbers, the bytes that wait for others, one row for each
piece, and packets that wait for their turn. Nothing outlives its flow: a reset, two FINs, or
a timer of event time behind the last packet takes all of it away.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from packetloom.operators.flows import KEY, FlowConfig
from packetloom.operators.reassembly import CLIENT, SERVER, Flow

#: The store that keeps state of more than one kind for a key.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
KEYS = "lower_key binary, lower_port int, upper_key binary, upper_port int"
PACKET = "ip_idx long, ms long, ts long, flow string, src_ip string, from_lower boolean, seq long, syn boolean, ack boolean, fin boolean, rst boolean, payload binary"
_WAY = "isn long, next long, delivered long, overlaps long, outside long, small_run long, told string"
FLOW = (
    "began long, last_idx long, last_ts long, last_flow string, src_ip string, from_lower boolean, sub long, initiator boolean, synced boolean, fins int, route string, looks int, stats string, pieces int,"
    + ", ".join(f"{side}_{c.strip()}" for side in ("c", "s") for c in _WAY.split(","))
)
SCHEMA = (
    KEYS + ", began long, flow string, what string, ip_idx long, sub long, ts long, direction string, offset long, data binary, category string, verdict string, confidence string, summary string,"
    " evidence array<string>, mitre_techniques array<string>, source_ip string, stats map<string,long>, route string, close_reason string"
)
_NAMES = [c.split()[0] for c in SCHEMA.replace("map<string,long>", "map").split(", ")]
_FLOW_NAMES = [c.split()[0] for c in FLOW.split(",")]


class Reassembly(StatefulProcessor):
    """``hold``: packets wait until the watermark has passed them, and are then taken in order of event time."""

    def __init__(self, config: FlowConfig, hold: bool, max_held: int):
        self.config, self.hold, self.max_held = config, hold, max_held

    def init(self, handle) -> None:
        self.handle = handle
        self.flow = handle.getValueState("flow", FLOW)
        self.pieces = handle.getMapState("pieces", "server boolean, start long", "data binary")
        self.held = handle.getListState("held", PACKET)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        names = [c.split()[0] for c in PACKET.split(", ")]
        packets = sorted(tuple(r[n] for n in names) for r in rows)  # of one micro-batch and one flow
        if not self.hold:
            yield from self._take(key, packets)
            return
        waiting = sorted([*map(tuple, self.held.get()), *packets], key=_time_order)
        more = max(0, len(waiting) - self.max_held)
        yield from self._take(key, waiting[:more])  # a flow's bound: the oldest can't wait any longer
        self._keep(waiting[more:])

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        if self.hold and self.held.exists():
            waiting = sorted(map(tuple, self.held.get()), key=_time_order)
            due = sum(p[1] < now for p in waiting)
            yield from self._take(key, waiting[:due])
            self._keep(waiting[due:])
        if self.flow.exists():
            flow, facts = self._load()
            if facts["last_ts"] * 1000 + self.config.timeout * 1000 < now:
                yield self._row(key, facts, flow.end(_last(key, facts)), "Timeout")
                self._clear()

    def close(self) -> None:
        pass

    def _keep(self, packets: list[tuple]) -> None:
        if not packets:
            self.held.clear()
            return
        self.held.put(packets)
        self.handle.registerTimer(packets[0][1] + 1)

    def _take(self, key: tuple, packets: Iterable[tuple]) -> Iterator[Row]:
        """Pass packets through the flow's state machine."""
        packets = list(packets)
        if not packets:
            return
        flow, facts = self._load() if self.flow.exists() else (None, {})
        for values in packets:
            p = dict(zip(("ip_idx", "ms", "ts", "flow", "src_ip", "from_lower", "seq", "syn", "ack", "fin", "rst", "payload"), values, strict=True))
            p |= {"lower_port": key[1], "upper_port": key[3], "payload": bytes(p["payload"] or b"")}
            if flow is not None and p["ts"] - facts["last_ts"] > self.config.timeout:
                yield self._row(key, facts, flow.end(_last(key, facts)), "Timeout")
                flow = None
            if flow is None:
                flow, facts = Flow(self.config), {"began": p["ip_idx"], "sub": 0}
            facts |= {"last_idx": p["ip_idx"], "last_ts": p["ts"], "last_flow": p["flow"], "src_ip": p["src_ip"], "from_lower": p["from_lower"]}
            for made in flow.packet(p):
                yield self._row(key, facts, made)
                facts["sub"] += 1
            if flow.closed:
                yield self._row(key, facts, flow.end(p), "Rst" if flow.reset else "Fin")
                flow = None
        if flow is None:
            self._clear()
        else:
            self._store(flow, facts)
            self.handle.registerTimer(facts["last_ts"] * 1000 + self.config.timeout * 1000 + 1)

    def _row(self, key: tuple, facts: dict, made: dict, reason: str | None = None) -> Row:
        p = made["p"]
        values = {n: made.get(n) for n in _NAMES} | dict(zip(KEY, key, strict=True))
        return Row(**values | {"began": facts["began"], "flow": p["flow"], "ip_idx": p["ip_idx"], "sub": facts["sub"], "ts": p["ts"], "close_reason": reason})

    def _clear(self) -> None:
        self.flow.clear()
        self.pieces.clear()

    def _store(self, flow: Flow, facts: dict) -> None:
        out = facts | {"initiator": flow.initiator, "synced": flow.synced, "fins": flow.fins, "route": flow.route, "looks": flow.looks, "stats": ",".join(f"{k}={v}" for k, v in flow.stats.items())}
        wanted = {(way == SERVER, start): data for way, stream in flow.streams.items() for start, data in stream.pieces.items()}
        for side, way in (("c", CLIENT), ("s", SERVER)):
            stream = flow.streams[way]
            out |= {f"{side}_isn": stream.isn, f"{side}_next": stream.next, f"{side}_delivered": stream.delivered, f"{side}_overlaps": stream.overlaps, f"{side}_outside": stream.outside, f"{side}_small_run": stream.small_run, f"{side}_told": ",".join(sorted(stream.told))}
        out["pieces"] = len(wanted)
        before = getattr(flow, "stored", set())
        for place in before - wanted.keys():
            self.pieces.removeKey(place)
        for place in wanted.keys() - before:  # a piece never changes
            self.pieces.updateValue(place, (wanted[place],))
        self.flow.update(tuple(out[n] for n in _FLOW_NAMES))

    def _load(self) -> tuple[Flow, dict]:
        facts = dict(zip(_FLOW_NAMES, self.flow.get(), strict=True))
        flow = Flow(self.config)
        flow.initiator, flow.synced, flow.fins, flow.route, flow.looks = (facts[n] for n in ("initiator", "synced", "fins", "route", "looks"))
        flow.stats.update({k: int(v) for k, v in (x.split("=") for x in facts["stats"].split(",") if x)})
        for side, way in (("c", CLIENT), ("s", SERVER)):
            stream = flow.streams[way]
            stream.isn, stream.next, stream.delivered = facts[f"{side}_isn"], facts[f"{side}_next"], facts[f"{side}_delivered"]
            stream.overlaps, stream.outside, stream.small_run = facts[f"{side}_overlaps"], facts[f"{side}_outside"], facts[f"{side}_small_run"]
            stream.told = set(facts[f"{side}_told"].split(",")) - {""}
        flow.stored = set()
        if facts["pieces"]:
            for (server, start), (data,) in ((tuple(k), tuple(v)) for k, v in self.pieces.iterator()):
                stream = flow.streams[SERVER if server else CLIENT]
                stream.pieces[start] = bytes(data)
                stream.waiting += len(data)
                flow.stored.add((server, start))
            for stream in flow.streams.values():
                stream.starts = sorted(stream.pieces)
        return flow, facts


def _time_order(p: tuple) -> tuple:
    return p[1], p[0]


def _last(key: tuple, facts: dict) -> dict:
    """What the closing row of a flow takes from its last packet."""
    return {"flow": facts["last_flow"], "ip_idx": facts["last_idx"], "ts": facts["last_ts"]}


def reassemble(packets: DataFrame, config: FlowConfig = FlowConfig(), lateness: str | None = None, max_held: int = 100_000) -> DataFrame:
    """Chunks, findings and counters of a stream of TCP packets, as rows of :data:`SCHEMA`.

    ``packets``: those of :func:`operators.flows.keyed` with ``ip_idx`` and ``event_time``. ``began``,
    the number of a flow's first packet, tells the flows of a key apart; ``sub`` counts a
    flow's rows. A flow ends with a reset, two FINs, or when it is idle for the
    configured time, by the next packet or by the watermark; its state goes with it.

    Without ``lateness`` packets count as they arrive, in order of ``ip_idx`` within a
    micro-batch, and a watermark of no delay ends idle flows: for sources in order. With it, for
    example "10 seconds", packets wait until the watermark has passed them and are then taken in
    order of event time and number, so whatever order they arrive in, the first bytes are those of
    the capture; packets behind the watermark are dropped by Spark. ``max_held`` bounds what waits
    of a flow: beyond it the oldest are taken at once. What waits for missing bytes is bounded by the
    configured depth, window and segments, as in batch. Rules by packet numbers
    (``idle_packets``) don't apply to streams. The session needs :data:`STATE_STORE`.
    """
    kept = [c for c in PACKET.split(", ") if not c.startswith("ms ")]
    marked = packets.withWatermark("event_time", lateness or "0 seconds")
    rows = marked.select(*KEY, "event_time", F.unix_millis("event_time").alias("ms"), *[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in kept])
    processor = Reassembly(config, lateness is not None, max_held)
    return rows.groupBy(*KEY).transformWithState(processor, SCHEMA, "Append", "EventTime")


def chunks(reassembled: DataFrame) -> DataFrame:
    """The chunks that have a protocol, as :func:`operators.dispatch.dispatch` gives in batch, with ``began`` for the instance."""
    return reassembled.where("what = 'chunk' AND route IS NOT NULL").select(*KEY, "began", "flow", "ip_idx", "sub", "ts", "direction", "offset", "data", "route")
