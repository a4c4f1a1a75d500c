"""Modbus TCP application data units of streams, and findings in them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.binary import u8, uint_be

from .anchored import WINDOW, Anchor
from .findings import finding, hex2, hex4, rows
from .flows import KEY, with_ips
from .ordered import ordered_map
from .reassembly import CLIENT, SERVER

CARRY, PORT, MOST_PENDING = 260, 502, 256
SCHEMA = (
    "lower_key binary, lower_port int, upper_key binary, upper_port int, inst long, at long, sub int, ts long, direction string, what string, adu binary,"
    + "".join(f" {name} {WINDOW}," for name in ("paired", "burst", "slow", "failed"))
    + " outcome string, request_fc int, seconds long"
)
# Function codes by class.
WRITE, DIAGNOSTIC = (0x05, 0x06, 0x0F, 0x10, 0x15, 0x16, 0x17), (0x08, 0x2B)
READ = (0x01, 0x02, 0x03, 0x04, 0x07, 0x0B, 0x0C, 0x11, 0x14, 0x18)
REGISTERS, COILS = (0x06, 0x10, 0x16, 0x17), (0x05, 0x0F)


class Machine:
    """One flow's units: half a unit each way, windows of writes and exceptions, requests without an answer."""

    def __init__(self, most_pending: int):
        self.held, self.foreign = {CLIENT: b"", SERVER: b""}, False
        self.paired, self.burst, self.slow = Anchor(5), Anchor(1), Anchor(2, restart_at=True)
        self.failed: dict[int, Anchor] = {}
        self.pending: dict[tuple[bytes, int], tuple[int, int]] = {}
        self.most_pending = most_pending

    def windows(self, adu: bytes, now: int, way: str) -> list[tuple | None]:
        fc = adu[7]
        if way == SERVER:
            code = adu[8] if len(adu) > 8 else 0xFF
            return [None, None, None, self.failed.setdefault(code, Anchor(10)).event(now) if fc >= 0x80 else None]
        if fc not in WRITE:
            return [None] * 4
        return [self.paired.event(now) if fc in REGISTERS else None, self.burst.event(now), self.slow.event(now), None]

    def transaction(self, adu: bytes, now: int, way: str) -> tuple[str | None, int | None, int | None]:
        """Outcome, code and age of the request that a unit belongs to.

        A request waits under its transaction and unit, in place of an earlier one; one too
        many is dropped. Any response closes the pair; an exception only that of its own code.
        """
        key, fc = (adu[:2], adu[6]), adu[7]
        held = self.pending.get(key)
        if way == CLIENT:
            if fc >= 0x80:
                return None, None, None
            if held is None and len(self.pending) >= self.most_pending:
                return "dropped", fc, None
            self.pending[key] = (fc, now)
            return ("request" if held is None else "duplicate"), fc, None
        if held is None:
            return "orphan", None, None
        if fc >= 0x80 and fc & 0x7F != held[0]:
            return "mismatch", held[0], None
        del self.pending[key]
        return ("matched" if fc < 0x80 else "exception"), held[0], max(0, now - held[1])

    def chunk(self, c: dict) -> Iterator[tuple]:
        """The rows of a chunk, without the flow's key."""
        if self.foreign:
            return
        way, at, sub, now = c["direction"], 0, 1000 * c["sub"], c["ts"]
        buffer, self.held[way] = self.held[way] + c["data"], b""
        while at < len(buffer) and not self.foreign:
            rest = len(buffer) - at
            size = 6 + int.from_bytes(buffer[at + 4 : at + 6], "big")
            if rest >= 8 and not (buffer[at + 2 : at + 4] == b"\0\0" and 8 <= size <= 260):
                self.foreign = True
            elif rest < 8 or rest < size:
                self.foreign = rest > CARRY
                self.held[way] = buffer[at:]
                break
            else:
                adu = buffer[at : at + size]
                yield (c["ip_idx"], sub, now, way, "adu", adu, *self.windows(adu, now, way), *self.transaction(adu, now, way))
                at, sub = at + size, sub + 1
        if self.foreign:
            yield (c["ip_idx"], sub, now, way, "error", *[None] * 8)


def units(routed: DataFrame, most_pending: int = MOST_PENDING) -> DataFrame:
    """Rows of ``SCHEMA``: adu for each unit, error where a flow turns out not to be Modbus.

    One pass over a flow's chunks frames the units, counts them in the windows that they
    are events of, and pairs responses with requests, of which ``most_pending`` may wait.
    """

    def run(key: tuple, chunks: Iterator[dict]) -> Iterator[tuple]:
        machine = Machine(most_pending)
        for c in chunks:
            for row in machine.chunk(c):
                yield (*key, *row)
            if machine.foreign:
                return

    mine = routed.where("route = 'Modbus'").select(*KEY, "inst", "ip_idx", "sub", "ts", "direction", "data")
    return ordered_map(mine, [*KEY, "inst"], ["ip_idx", "sub"], run, SCHEMA)


def pairs(found: DataFrame) -> DataFrame:
    """Requests and responses with what became of them: request, duplicate (in place of one that waited), dropped
    (too many waited); matched, exception (with the request's code and the seconds since), mismatch, orphan."""
    return fields(found).where("outcome IS NOT NULL").select(*KEY, "inst", "at", "sub", "ts", "direction", "txn", "unit", "fc", "outcome", "request_fc", "seconds")


def code_class(fc: Column) -> Column:
    return F.when(fc >= 0x80, "Exception").when(fc.isin(*WRITE), "Write").when(fc.isin(*DIAGNOSTIC), "Diagnostic").when(fc.isin(*READ), "Read").otherwise("Unknown")


def fields(found: DataFrame) -> DataFrame:
    """Units with txn, unit, fc, code_class and exception (0xFF where it is missing)."""
    adu = F.col("adu")
    df = found.where("what = 'adu'").withColumns({"txn": uint_be(adu, 0, 2), "unit": u8(adu, 6), "fc": u8(adu, 7)})
    df = df.withColumn("code_class", code_class(F.col("fc")))
    return df.withColumn("exception", F.when((F.col("code_class") == "Exception") & (F.col("direction") == SERVER), F.coalesce(u8(adu, 8), F.lit(0xFF))))


def detect(found: DataFrame, burst: int = 20, sustained: int = 10, exceptions: int = 5) -> DataFrame:
    """Findings in the rows of :func:`units`, each from its row alone."""
    df = with_ips(fields(found))
    lower_serves = F.col("lower_port") == PORT
    client = F.when(lower_serves, F.col("upper_ip")).otherwise(F.col("lower_ip"))
    server = F.when(lower_serves, F.col("lower_ip")).otherwise(F.col("upper_ip"))
    df = df.withColumns({"client": client, "server": server, "is_write": (F.col("direction") == CLIENT) & (F.col("code_class") == "Write")})

    text = lambda c: F.col(c).cast("string")
    fc, unit, txn, adu = F.col("fc"), text("unit"), hex4(F.col("txn")), F.col("adu")
    ids = F.concat(F.lit(" TxnID="), txn, F.lit(" UnitID="), unit)
    own = F.when(F.col("direction") == CLIENT, F.col("client")).otherwise(F.col("server"))
    sub_function = uint_be(adu, 8, 2)
    diagnostic = (F.col("direction") == CLIENT) & (fc == 0x08)
    write = F.col("is_write")
    techniques = F.concat(
        F.array(F.lit("T1692.001")), F.when(fc.isin(*REGISTERS), F.array(F.lit("T0836"))).when(fc.isin(*COILS), F.array(F.lit("T0835"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("paired.win_count") == 2, F.array(F.lit("T0831"))).otherwise(F.array().cast("array<string>")),
    )
    n = lambda c: F.col(c).cast("string")
    cat = F.concat
    code = F.col("exception")
    failing = (
        F.when(code == 1, cat(F.lit("Modbus recon: "), n("failed.win_count"), F.lit(" Illegal Function exceptions in window (unit "), unit, F.lit(") — possible FC scanning")))
        .when(code == 2, cat(F.lit("Modbus recon: "), n("failed.win_count"), F.lit(" Illegal Data Address exceptions in window (unit "), unit, F.lit(") — possible register map enumeration")))
        .otherwise(cat(F.lit("Modbus exception anomaly: "), n("failed.win_count"), F.lit(" exceptions code "), hex2(code), F.lit(" in window (unit "), unit, F.lit(")")))
    )
    too_many = (F.col("slow.elapsed") >= 2) & (F.col("slow.win_count") > F.col("slow.elapsed") * sustained)
    at = F.col("at") * 1_000_000 + F.col("sub") * 10
    where = F.col("direction")
    return rows(df, 4, at, F.col("ts"), [
        (fc == 0x11, finding("Anomaly", "Inconclusive", "Medium", cat(F.lit("Modbus recon: Report Server ID (FC 0x11) from unit "), unit), F.array(cat(F.lit("FC=0x11"), ids)), ["T0888"], 1, own, where)),
        ((fc == 0x2B) & (u8(adu, 8) == 0x0E), finding("Anomaly", "Inconclusive", "Medium", cat(F.lit("Modbus recon: Read Device Identification (MEI 0x2B/0x0E) on unit "), unit), F.array(cat(F.lit("FC=0x2B MEI type=0x0E"), ids)), ["T0888"], 1, own, where)),
        (F.col("code_class") == "Unknown", finding("Anomaly", "Inconclusive", "Low", cat(F.lit("Modbus unknown function code: "), hex2(fc), F.lit(" on unit "), unit), F.array(cat(F.lit("FC="), hex2(fc), ids)), [], 1, own, where)),
        (write, finding("Execution", "Likely", "Medium", cat(F.lit("Modbus write command observed: FC "), hex2(fc), F.lit(" from unit "), unit), F.array(cat(F.lit("FC="), hex2(fc), ids, F.lit(" ADU bytes 0.."), F.octet_length(adu).cast("string"))), techniques, 2, F.col("client"), where)),
        (write & (F.col("burst.win_count") == burst + 1), finding("Execution", "Likely", "High", cat(F.lit("Modbus write burst: "), n("burst.win_count"), F.lit(" writes within 1s window (unit "), unit, F.lit(f", threshold {burst}/s)")), F.array(cat(F.lit("Burst threshold exceeded: "), n("burst.win_count"), F.lit(" write FCs in 1s window; window_write_count="), n("burst.win_count"), F.lit(" window_start_ts="), n("burst.win_start"), F.lit(f" threshold={burst} FC="), hex2(fc), F.lit(" UnitID="), unit)), ["T0806", "T1692.001"], 3, F.col("client"), where)),
        (write & too_many, finding("Execution", "Likely", "High", cat(F.lit("Modbus write burst: "), n("slow.win_count"), F.lit(" writes over "), n("slow.elapsed"), F.lit("s window (unit "), unit, F.lit(f", >{sustained}/s avg)")), F.array(cat(F.lit("Sustained write rate exceeded: "), n("slow.win_count"), F.lit(" writes over "), n("slow.elapsed"), F.lit(f" seconds (>{sustained}/s average); sustained_window_start_ts="), n("slow.win_start"), F.lit(" FC="), hex2(fc), F.lit(" UnitID="), unit)), ["T0806", "T1692.001"], 4, F.col("client"), where)),
        (diagnostic & sub_function.isin(1, 4), finding("Anomaly", "Likely", "High", cat(F.lit("Modbus Diagnostics DoS sub-function "), hex4(sub_function), F.lit(" detected")), F.array(cat(F.lit("FC=0x08 sub-func="), hex4(sub_function), F.lit(" unit_id="), hex2(F.col("unit")))), ["T0814"], 5, F.col("client"), where)),
        (diagnostic & (sub_function == 0x0A), finding("Anomaly", "Inconclusive", "Medium", cat(F.lit("Modbus anti-forensic: Clear Counters (0x08/0x000A) sent to unit "), unit), F.array(cat(F.lit("FC=0x08 SubFunc=0x000A"), ids)), [], 5, F.col("client"), where)),
        (F.col("failed.win_count") == exceptions + 1, finding("Anomaly", "Inconclusive", "Medium", failing, F.array(cat(F.lit("exception_fc="), hex2(fc), F.lit(" exception_code="), hex2(code), F.lit(" window_count="), n("failed.win_count"), F.lit(" original_fc="), hex2(fc.bitwiseAND(F.lit(0x7F).cast("long"))))), F.when(code.isin(1, 2), F.array(F.lit("T0888"))).otherwise(F.array().cast("array<string>")), 6, F.col("server"), where)),
    ])


def counts(found: DataFrame) -> DataFrame:
    """``field``, ``value``, ``n``: the counters and the distribution of function codes."""
    df = fields(found)
    codes = df.groupBy(hex2(F.col("fc")).alias("value")).agg(F.count("*").alias("n")).withColumn("field", F.lit("function_code_distribution"))
    sums = df.agg(F.count("*").alias("pdu_count"), F.count_if((F.col("direction") == CLIENT) & (F.col("code_class") == "Write")).alias("write_count"), F.count("exception").alias("exception_count"))
    errors = found.agg(F.count_if(F.col("what") == "error").alias("parse_errors"))
    wide = sums.crossJoin(errors)
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("value"), F.col(c).alias("n")) for c in wide.columns])).alias("x")).select(F.lit("counters").alias("field"), "x.*")
    return long.unionByName(codes)
