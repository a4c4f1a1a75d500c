"""DNP3 link frames of streams, and findings in them.

State lasts for a key, over all its instances.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .anchored import anchored_windows, with_windows
from .findings import finding, hex2, hex4, rows
from .flows import KEY, with_ips
from .ordered import ordered_map
from .reassembly import CLIENT, SERVER

CARRY, PORT, SYNC = 292, 20000, b"\x05\x64"
TIMEOUT, CORRELATION, MOST_PENDING, MOST_MASTERS = 10, 300, 256, 64
SCHEMA = (
    "lower_key binary, lower_port int, upper_key binary, upper_port int, at long, sub int, ts long, direction string, what string,"
    " control int, dest int, source int, app_control int, fc int, masters array<int>, n long, restarts long, blocks long, elapsed long"
)


def frame_length(n: int) -> int | None:
    """Bytes of a link frame whose length field is ``n``: a checksum for each sixteen bytes of user data."""
    return None if n < 5 else 5 + n + 2 * -(-(n - 5) // 16)


class _Flow:
    """What a flow remembers: half a frame each way, requests without answers, counts of a correlation window."""

    def __init__(self):
        self.held = {CLIENT: b"", SERVER: b""}
        self.started = self.foreign = False
        self.pending: dict[tuple[int, int], int] = {}
        self.masters: list[int] = []
        self.start = None
        self.clear()

    def clear(self) -> None:
        self.restarts = self.blocks = self.bad = 0
        self.told: set[str] = set()

    def clock(self, now: int) -> None:
        if self.start is None or now - self.start > CORRELATION:
            if self.start is not None:
                self.clear()
            self.start = now

    def once(self, what: str, condition: bool) -> bool:
        if condition and what not in self.told:
            self.told.add(what)
            return True
        return False

    def late(self, now: int) -> int | None:
        """Drop requests without an answer; the least destination among them."""
        gone = [k for k, t in self.pending.items() if now - t > TIMEOUT]
        for k in gone:
            del self.pending[k]
        self.blocks += len(gone)
        return min((k[0] for k in gone), default=None)

    def resync(self, way: str, skip: int) -> None:
        at = self.held[way].find(SYNC, skip)
        self.held[way] = self.held[way][at:] if at >= 0 else b""


def frames(routed: DataFrame) -> DataFrame:
    """Rows of ``SCHEMA``: frame, malformed (n bad frames so far), structure, blocked and loss (alerts of a window)."""

    def run(key: tuple, chunks: Iterator[dict]) -> Iterator[tuple]:
        flow = _Flow()
        for c in chunks:
            if flow.foreign:
                return
            way, now, data, sub = c["direction"], c["ts"], c["data"], 1000 * c["sub"]

            def row(what, control=None, dest=None, source=None, app=None, fc=None, n=None, c=c, way=way, now=now):
                nonlocal sub
                sub += 1
                return (*key, c["ip_idx"], sub, now, way, what, control, dest, source, app, fc, list(flow.masters), n, flow.restarts, flow.blocks, max(0, now - flow.start))

            def bad(now=now):
                flow.bad += 1
                yield row("malformed", n=flow.bad)
                if now - flow.start < CORRELATION and flow.once("bad", flow.bad >= 3):
                    yield row("structure", n=flow.bad)

            if not flow.started and not any(flow.held.values()) and len(data) >= 2 and data[:2] != SYNC:
                flow.foreign = True
                continue
            flow.clock(now)
            least = flow.late(now)
            if flow.once("blocked", flow.blocks >= 3):
                yield row("blocked", dest=least or 0, n=flow.blocks)
            if least is not None and flow.once("loss", flow.restarts + flow.blocks >= 3):
                yield row("loss", dest=least)

            room = CARRY - len(flow.held[way])
            flow.held[way] += data[:room]
            if len(data) > room:
                flow.resync(way, 0)
                yield from bad()
            worked = False
            while len(flow.held[way]) >= 2:
                buffer = flow.held[way]
                if buffer[:2] != SYNC:
                    worked = worked or len(buffer) >= 10
                    flow.resync(way, 1)
                    yield from bad()
                    if len(buffer) < 10:
                        break
                    continue
                size = frame_length(buffer[2]) if len(buffer) >= 3 else 0
                if size is None and (len(buffer) >= 10 or worked):
                    flow.resync(way, 1)
                    yield from bad()
                    if len(buffer) < 10:
                        break
                    worked = True
                    continue
                if len(buffer) < 10:
                    break
                worked = True
                if len(buffer) < size:
                    break
                flow.held[way] = buffer[size:]
                flow.started = True
                control, dest, source = buffer[3], int.from_bytes(buffer[4:6], "little"), int.from_bytes(buffer[6:8], "little")
                app = fc = None
                if size >= 13 and control & 0x0F in (3, 4) and buffer[10] & 0x40:
                    app, fc = buffer[11], buffer[12]
                if fc in (0x0D, 0x0E):
                    flow.restarts += 1
                yield row("frame", control, dest, source, app, fc)
                if control & 0x80 and source not in flow.masters and len(flow.masters) < MOST_MASTERS:
                    flow.masters.append(source)
                if fc in (0x03, 0x04, 0x05):
                    if len(flow.pending) >= MOST_PENDING and (dest, app & 15) not in flow.pending:
                        del flow.pending[min(flow.pending, key=flow.pending.get)]
                    flow.pending[dest, app & 15] = now
                elif fc == 0x81:
                    flow.pending.pop((source, app & 15), None)
                elif fc in (0x0D, 0x0E) and flow.once("loss", flow.restarts + flow.blocks >= 3):
                    yield row("loss", dest=dest)

    mine = routed.where("route = 'Dnp3'").select(*KEY, "ip_idx", "sub", "ts", "direction", "data")
    return ordered_map(mine, KEY, ["ip_idx", "sub"], run, SCHEMA)


def code_class(fc: Column) -> Column:
    known = F.when(fc == 1, "Read").when(fc == 2, "Write").when(fc.between(3, 6), "Control").when(fc.isin(0x0D, 0x0E), "Restart")
    return known.when((fc >= 0) & (fc <= 0x1A), "Management").when(fc.between(0x81, 0x83), "Response").otherwise("Unknown")


def detect(found: DataFrame, threshold: int = 10) -> DataFrame:
    """Findings in the rows of :func:`frames`. No finding has a direction."""
    order = ["at", "sub"]
    lower_serves = F.col("lower_port") == PORT
    from_client = F.col("direction") == CLIENT
    who = F.when(lower_serves == from_client, F.col("upper_ip")).otherwise(F.col("lower_ip"))
    fc, kind = F.col("fc"), code_class(F.col("fc"))
    control = (F.col("what") == "frame") & (kind == "Control")
    df = with_ips(with_windows(found, KEY, order, "ts", {"burst": (control, 60)}))
    df = df.withColumns({"win_count": F.col("burst.win_count"), "burst_elapsed": F.col("burst.elapsed")})
    w = Window.partitionBy(*KEY).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    stranger = control & (F.col("control").bitwiseAND(0x80) != 0) & (F.size("masters") > 0) & ~F.array_contains("masters", F.col("source"))
    asked = F.coalesce(F.count_if(fc.isin(0x14, 0x81)).over(before), F.lit(0))
    df = df.withColumns({"_stranger": F.coalesce(stranger, F.lit(False)), "_lone": F.coalesce((fc == 0x82) & (asked == 0), F.lit(False))})
    first = lambda c: F.col(c) & (F.coalesce(F.count_if(F.col(c)).over(before), F.lit(0)) == 0)
    df = df.withColumns({"_stranger": first("_stranger"), "_lone": first("_lone")})

    cat, n = F.concat, lambda c: F.col(c).cast("string")
    dest, source, code = hex4(F.col("dest")), hex4(F.col("source")), hex2(fc)
    seen = F.array(cat(F.lit("FC="), code, F.lit(" dest="), dest, F.lit(" src="), source))
    way = cat(F.lit("from src="), source, F.lit(" to dest="), dest)
    masters = cat(F.lit("["), F.array_join(F.transform("masters", lambda m: hex4(m)), ", "), F.lit("]"))
    name = F.when(fc == 0x0D, "COLD_RESTART").otherwise("WARM_RESTART")
    what = F.col("what")
    flow = cat(F.lit("flow "), F.col("lower_ip"), F.lit("→"), F.col("upper_ip"))
    uns = F.when(F.col("app_control").bitwiseAND(0x10) != 0, "true").otherwise("false")
    return rows(df, 5, F.col("at") * 1_000_000 + F.col("sub") * 10, F.col("ts"), [
        (fc == 0x15, finding("Execution", "Likely", "Medium", cat(F.lit("DNP3 DISABLE_UNSOLICITED observed: FC 0x15 "), way, F.lit(" — alarm suppression / event-blinding primitive")), seen, ["T0814"], 1, who)),
        (fc == 0x14, finding("Execution", "Possible", "Low", cat(F.lit("DNP3 ENABLE_UNSOLICITED observed: FC 0x14 "), way, F.lit(" — unsolicited reporting control")), seen, ["T0814"], 1, who)),
        (control & (F.col("dest") >= 0xFFFD), finding("Suspicious", "Possible", "Medium", cat(F.lit("DNP3 broadcast control command: Control FC "), code, F.lit(" sent to broadcast destination "), dest), F.array(cat(F.lit("FC="), code, F.lit(" dest="), dest, F.lit(" (broadcast) src="), source)), ["T1692.001"], 2, who)),
        (F.col("_stranger"), finding("Execution", "Likely", "High", cat(F.lit("DNP3 unauthorized control command from unexpected source: src="), source, F.lit(" is not in expected master set "), masters, F.lit(" on dest="), dest), F.concat(seen, F.array(cat(F.lit("expected_masters="), masters))), ["T1692.001"], 3, who)),
        (control & (F.col("win_count") == threshold + 1), finding("Execution", "Likely", "Medium", cat(F.lit("DNP3 unauthorized control command burst: "), n("win_count"), F.lit(" control FCs in "), n("burst_elapsed"), F.lit(f"s window (threshold {threshold})")), seen, ["T1692.001"], 4, who)),
        ((what == "frame") & (kind == "Restart"), finding("Execution", "Likely", "High", cat(F.lit("DNP3 restart command observed: FC "), code, F.lit(" ("), name, F.lit(") "), way), seen, ["T0814"], 5, who)),
        (fc == 0x02, finding("Execution", "Likely", "Medium", cat(F.lit("DNP3 WRITE command observed: parameter modification "), way), F.array(cat(F.lit("FC=0x02 (WRITE) dest="), dest, F.lit(" src="), source)), ["T0836"], 5, who)),
        (F.col("_lone"), finding("Suspicious", "Possible", "Low", cat(F.lit("DNP3 unexpected unsolicited response: UNSOLICITED_RESPONSE from src="), source, F.lit(" with no prior ENABLE_UNSOLICITED or solicited exchange on this flow")), F.array(cat(F.lit("FC=0x82 src="), source, F.lit(" dest="), dest, F.lit(" UNS_bit="), uns)), ["T0814"], 5, who)),
        (what == "blocked", finding("Execution", "Possible", "Low", cat(F.lit("DNP3 inferred blocked command: "), n("n"), F.lit(f" requests without response within {TIMEOUT}s (dest="), dest, F.lit(")")), F.array(cat(F.lit("block_event_count="), n("n"), F.lit(" in correlation window; threshold=3"))), ["T1691.001"], 6, who)),
        (what == "loss", finding("Impact", "Likely", "Medium", cat(F.lit("DNP3 sustained loss-of-control pattern: "), n("restarts"), F.lit(" restart events + "), n("blocks"), F.lit(" blocked commands within "), n("elapsed"), F.lit("s on flow (dest="), dest, F.lit(")")), F.array(cat(F.lit("restart_event_count="), n("restarts"), F.lit(" block_event_count="), n("blocks"), F.lit(" threshold=3"))), ["T0827"], 7, who)),
        (what == "structure", finding("Anomaly", "Possible", "Low", cat(F.lit("DNP3 structural anomaly: "), n("n"), F.lit(" malformed frames in "), n("elapsed"), F.lit("s window ("), flow, F.lit(") — possible Crain-Sistrunk crash-probe")), F.array(cat(F.lit("malformed_in_window="), n("n"), F.lit(" in correlation window; threshold=3"))), ["T0814"], 8, who)),
    ])


def counts(found: DataFrame, routed: DataFrame) -> DataFrame:
    """``field``, ``value``, ``n``: frames, parse errors, flows, function codes, and each flow's control requests.

    Flows are numbered from 0 by their ends; a flow's control requests are those of its last window.
    """
    frame = found.where("what = 'frame'")
    codes = frame.where("fc IS NOT NULL").groupBy(F.col("fc").cast("string").alias("value")).agg(F.count("*").alias("n")).withColumn("field", F.lit("function_code_distribution"))
    sums = found.where(F.col("what").isin("frame", "malformed")).groupBy(F.when(F.col("what") == "frame", "total_frames").otherwise("parse_errors").alias("value")).agg(F.count("*").alias("n")).withColumn("field", F.lit("counters"))
    flows = routed.where("route = 'Dnp3'").select(*KEY).distinct()
    total = flows.agg(F.count("*").alias("n")).select(F.lit("flows_analyzed").alias("value"), "n", F.lit("counters").alias("field"))
    control = anchored_windows(frame.where(code_class(F.col("fc")) == "Control"), KEY, ["at", "sub"], "ts", 60)
    last = control.groupBy(*KEY).agg(F.max_by("win_count", F.struct("at", "sub")).alias("n"))
    per = flows.join(last, KEY, "left").select(F.struct(*KEY).alias("key"), F.coalesce("n", F.lit(0)).alias("n"))
    # Only the flows' rows, of a few bytes each, are numbered in one task.
    per = per.select((F.row_number().over(Window.orderBy("key")) - 1).cast("string").alias("value"), "n", F.lit("control_operation_counts").alias("field"))
    return codes.unionByName(sums).unionByName(total).unionByName(per)
