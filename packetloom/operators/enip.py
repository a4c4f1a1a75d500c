"""EtherNet/IP frames and CIP services of streams, and findings in them.

Framing is a small state machine; what is in a frame is taken apart by expressions.
State lasts for a key, over all its instances.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.binary import part, u8, uint_le

from .anchored import with_windows
from .findings import finding, hex2, hex4, rows
from .flows import KEY, with_ips
from .ordered import ordered_map
from .reassembly import CLIENT, SERVER

CARRY, PORT, MALFORMED_WINDOW = 600, 44818, 300
COMMANDS = (0x0000, 0x0004, 0x0063, 0x0064, 0x0065, 0x0066, 0x006F, 0x0070, 0x0072)
SCHEMA = "lower_key binary, lower_port int, upper_key binary, upper_port int, at long, sub int, ts long, direction string, what string, frame binary, n long, elapsed long"
# CIP services by number.
SERVICES = {
    0x01: "GetAttributesAll",
    0x02: "SetAttributesAll",
    0x03: "GetAttributeList",
    0x04: "SetAttributeList",
    0x05: "Reset",
    0x06: "Start",
    0x07: "Stop",
    0x0E: "GetAttributeSingle",
    0x10: "SetAttributeSingle",
    0x4E: "ForwardClose",
    0x54: "ForwardOpen",
    0x5B: "LargeForwardOpen",
}


def frames(routed: DataFrame) -> DataFrame:
    """Rows of ``SCHEMA``: frame, malformed (n in the window so far), structure (the window's alert)."""

    def run(key: tuple, chunks: Iterator[dict]) -> Iterator[tuple]:
        held = {CLIENT: b"", SERVER: b""}
        start = bad = 0
        told = False
        for c in chunks:
            way, now, at, sub = c["direction"], c["ts"], 0, 1000 * c["sub"]

            def row(what, frame=None, n=None, c=c, way=way, now=now):
                nonlocal sub
                sub += 1
                return (*key, c["ip_idx"], sub, now, way, what, frame, n, max(0, now - start))

            def malformed():
                nonlocal bad, told
                bad += 1
                yield row("malformed", n=bad)
                if bad >= 3 and not told:
                    told = True
                    yield row("structure", n=bad)

            if now - start > MALFORMED_WINDOW:
                start, bad, told = now, 0, False
            buffer = held[way] + c["data"]
            queue = []
            while len(buffer) - at >= 24:
                command, length = int.from_bytes(buffer[at : at + 2], "little"), int.from_bytes(buffer[at + 2 : at + 4], "little")
                if command not in COMMANDS:
                    at += 1
                    yield from malformed()
                elif 24 + length > CARRY:
                    at = min(at + 24 + length, len(buffer))
                    yield from malformed()
                elif len(buffer) - at < 24 + length:
                    break
                else:
                    queue.append(buffer[at : at + 24 + length])
                    at += 24 + length
            held[way] = buffer[at:]
            foreign = len(held[way]) > CARRY
            if foreign:
                yield from malformed()
            for frame in queue:
                yield row("frame", frame)
            if foreign:
                return

    mine = routed.where("route = 'Enip'").select(*KEY, "ip_idx", "sub", "ts", "direction", "data")
    return ordered_map(mine, KEY, ["ip_idx", "sub"], run, SCHEMA)


def items(data: Column) -> Column:
    """Common packet format: a count, then type, length and data of each item, up to the first that is cut off."""
    kind = "array<struct<type:bigint,data:binary>>"

    def step(acc: Column, _: Column) -> Column:
        at, size = acc["at"], uint_le(data, acc["at"] + 2, 2).cast("int")
        fits = (at >= 0) & size.isNotNull() & (at + 4 + size <= F.octet_length(data))
        one = F.array(F.struct(uint_le(data, at, 2).alias("type"), part(data, at + 4, size).alias("data")))
        return F.struct(F.when(fits, at + 4 + size).otherwise(-1).alias("at"), F.when(fits, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    n = F.least(F.coalesce(uint_le(data, 0, 2), F.lit(0)), F.lit(CARRY // 4)).cast("int")
    zero = F.struct(F.lit(2).alias("at"), F.array().cast(kind).alias("found"))
    turns = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(turns, zero, step, lambda acc: acc["found"])


def services(found: DataFrame) -> DataFrame:
    """CIP requests and responses in SendRRData and SendUnitData frames: service, status, classes, and the frame's fields."""
    frame = F.col("frame")
    df = found.where("what = 'frame'").withColumns({"command": uint_le(frame, 0, 2), "session": uint_le(frame, 4, 4)})
    df = df.where(F.col("command").isin(0x006F, 0x0070) & (F.octet_length("frame") > 30))
    each = F.posexplode(items(F.substring(frame, F.lit(31), F.octet_length(frame))))
    df = df.select(*[c for c in df.columns if c != "frame"], each.alias("nth", "item")).where("item.type = 178").withColumn("cip", F.col("item.data"))
    cip = F.col("cip")
    words = u8(cip, 1)
    response = u8(cip, 0).bitwiseAND(F.lit(0x80).cast("long")) != 0
    df = df.withColumns({"service": u8(cip, 0), "response": response, "status": F.when(response, u8(cip, 2)), "path": part(cip, 2, F.coalesce(words, F.lit(0)) * 2)})
    df = df.where(words.isNotNull() & (F.octet_length("cip") >= 2 + F.when(F.col("response"), F.lit(0)).otherwise(words * 2)))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.octet_length("path") - 2), F.lit(2)), lambda i: F.struct(u8(F.col("path"), i).alias("kind"), u8(F.col("path"), i + 1).alias("id")))
    classes = F.transform(F.filter(pairs, lambda p: p["kind"] == 0x20), lambda p: p["id"])
    return df.withColumn("classes", F.when(F.octet_length("path") >= 2, classes).otherwise(F.array().cast("array<bigint>"))).withColumn("sub", F.col("sub") * 100 + F.col("nth")).drop("item", "cip", "path", "nth")


def detect(found: DataFrame, write_burst: int = 50, error_burst: int = 5) -> DataFrame:
    """Findings in the rows of :func:`frames`. No finding has a direction."""
    order = ["at", "sub"]
    lower_serves = F.col("lower_port") == PORT
    who = lambda: F.when(lower_serves == (F.col("direction") == CLIENT), F.col("upper_ip")).otherwise(F.col("lower_ip"))
    other = lambda: F.when(lower_serves == (F.col("direction") == CLIENT), F.col("lower_ip")).otherwise(F.col("upper_ip"))
    cat, n, lit = F.concat, lambda c: F.col(c).cast("string"), F.lit

    top = with_ips(found).withColumns({"command": uint_le(F.col("frame"), 0, 2), "session": uint_le(F.col("frame"), 4, 4)})
    listing = (F.col("what") == "frame") & (F.col("command") == 0x0063)
    w = Window.partitionBy(*KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = listing & (F.coalesce(F.count_if(listing).over(w), lit(0)) == 0)
    top = top.withColumn("_first", F.coalesce(first, lit(False)))
    out = rows(top, 6, F.col("at") * 10**9 + F.col("sub") * 1000, F.col("ts"), [
        (F.col("_first"), finding("Reconnaissance", "Likely", "High", lit("EtherNet/IP ListIdentity broadcast observed: network-wide device enumeration (T0846)"), F.array(cat(lit("ENIP command=0x0063 (ListIdentity) src="), who(), lit(" session="), n("session"))), ["T0846"], 1, who())),
        (F.col("what") == "structure", finding("Anomaly", "Possible", "Low", cat(lit("EtherNet/IP structural anomaly: "), n("n"), lit(" malformed frames in "), n("elapsed"), lit("s window (flow "), who(), lit("→"), other(), lit(") — possible crash-probe")), F.array(cat(lit("malformed_in_window="), n("n"), lit("; threshold=3"))), ["T0814"], 2, who())),
    ])

    df = services(found)
    failed = F.col("response") & (F.coalesce("status", lit(0)) != 0)
    writes = ~F.col("response") & F.col("service").isin(0x02, 0x04, 0x10)
    df = with_ips(with_windows(df, KEY, order, "ts", {"fast": (writes, 1), "slow": (failed, 10)}))
    df = df.withColumns({"written": F.col("fast.win_count"), "errors": F.col("slow.win_count"), "win_no": F.col("slow.win_no")})
    # statuses of the error window so far, as many as stand before its alert
    near = Window.partitionBy(*KEY, "win_no").orderBy(*order).rowsBetween(-error_burst, 0)
    df = df.withColumn("_statuses", F.sort_array(F.collect_list(F.when(F.col("win_no").isNotNull(), F.col("status"))).over(near)))
    tally = F.array_join(F.transform(F.array_distinct("_statuses"), lambda s: cat(s.cast("string"), lit(": "), F.size(F.filter("_statuses", lambda x: x == s)).cast("string"))), ", ")

    service = F.col("service")
    name = F.coalesce(F.try_element_at(F.create_map(*[lit(x) for kv in SERVICES.items() for x in kv]), service.cast("int")), lit("Unknown"))
    ask = ~F.col("response")
    call = cat(lit("CIP service="), hex2(service), lit(" ("), name, lit(")"))
    session = cat(lit(" session="), n("session"))
    command = cat(lit(" from src="), who(), lit(" ENIP cmd="), hex4(F.col("command")), session)
    opening, closing = service.isin(0x54, 0x5B), service == 0x4E
    opened = cat(call, lit(" from src="), who(), session, lit(". No dedicated MITRE ICS technique for CIP connection establishment anomaly; T1692.001 applies only when connection demonstrably carries unauthorized command (ADR-010 Decision 7)"))
    closed = cat(call, lit(" from src="), who(), session, lit(". Connection lifecycle closed; no dedicated MITRE ICS technique (ADR-010 Decision 7)"))
    more = rows(df, 6, F.col("at") * 10**9 + F.col("sub") * 10, F.col("ts"), [
        (ask & service.isin(0x01, 0x03, 0x0E) & F.array_contains("classes", lit(1).cast("bigint")), finding("Reconnaissance", "Likely", "High", lit("CIP Identity Object attribute read: single-device reconnaissance (T0888)"), F.array(cat(call, lit(" path targets Identity Object (class 0x01) src="), who())), ["T0888"], 1, who())),
        (ask & (service == 0x07), finding("Execution", "Likely", "High", lit("CIP Stop service observed: controller run→stop transition command (T0858)"), F.array(cat(call, command)), ["T0858"], 2, who())),
        (ask & (service == 0x05), finding("Execution", "Likely", "High", lit("CIP Reset service observed: adversary-triggered device restart (T0816)"), F.array(cat(call, command)), ["T0816"], 3, who())),
        (F.col("written") == write_burst + 1, finding("Execution", "Likely", "Medium", cat(lit("CIP write-class service burst: "), n("written"), lit(f" SetAttribute operations in 1s window (threshold {write_burst}) — possible parameter modification attack (T0836)")), F.array(cat(call, lit(" src="), who(), lit(" ENIP"), session)), ["T0836"], 4, who())),
        (F.col("errors") == error_burst + 1, finding("Reconnaissance", "Possible", "Medium", cat(lit("CIP error-response burst: "), n("errors"), lit(" error responses in 10s window — possible service enumeration (T0888)")), F.array(cat(lit("error_counts_in_window={"), tally, lit("} within 10s; possible service probe"))), ["T0888"], 5, who())),
        (ask & opening, finding("Anomaly", "Possible", "Low", cat(lit("CIP ForwardOpen connection establishment observed from src="), who(), lit(": connection lifecycle anomaly")), F.array(opened), [], 6, who())),
        (ask & closing, finding("Anomaly", "Possible", "Low", cat(lit("CIP ForwardClose connection teardown observed from src="), who(), lit(": connection lifecycle closed")), F.array(closed), [], 6, who())),
    ])
    return out.unionByName(more)


def counts(found: DataFrame, routed: DataFrame) -> DataFrame:
    """``field``, ``value``, ``n``: frames, malformed ones, CIP errors and writes, commands."""
    commands = found.where("what = 'frame'").groupBy(hex4(uint_le(F.col("frame"), 0, 2)).alias("value")).agg(F.count("*").alias("n")).withColumn("field", F.lit("command_distribution"))
    sums = found.where(F.col("what").isin("frame", "malformed")).groupBy(F.when(F.col("what") == "frame", "total_pdu_count").otherwise("parse_errors").alias("value")).agg(F.count("*").alias("n")).withColumn("field", F.lit("counters"))
    kind = F.when(F.col("response") & (F.coalesce("status", F.lit(0)) != 0), "error_count").when(~F.col("response") & F.col("service").isin(2, 4, 16), "write_count")
    cip = services(found).select(kind.alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n")).withColumn("field", F.lit("counters"))
    flows = routed.where("route = 'Enip'").select(*KEY).distinct().agg(F.count("*").alias("n")).select(F.lit("flows_analyzed").alias("value"), "n", F.lit("counters").alias("field"))
    return commands.unionByName(sums).unionByName(cip).unionByName(flows)
