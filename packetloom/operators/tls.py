"""TLS hellos of streams: fingerprints, server names, weak ciphers, old versions."""

from __future__ import annotations

from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.binary import hex_of

from .findings import finding, rows
from .flows import KEY
from .http import MOST_KEYS, first_keys
from .ordered import ordered_map
from .reassembly import CLIENT, SERVER
from .suites import suites

BUFFER, MOST_RECORD = 65_536, 18_432
HANDSHAKE, CLIENT_HELLO, SERVER_HELLO = 0x16, 1, 2
SCHEMA = "lower_key binary, lower_port int, upper_key binary, upper_port int, inst long, at long, sub int, ts long, what string, version int, ciphers array<int>, extensions array<int>, curves array<int>, point_formats array<int>, sni binary"


class _Reader:
    """Fields of a hello, one after the other; reading past the end raises IndexError."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise IndexError
        self.at += n
        return out

    def uint(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def list_of(self, size: int, n: int) -> list[int]:
        data = self.take(size)
        return [int.from_bytes(data[i : i + n], "big") for i in range(0, len(data) - n + 1, n)]


def _extensions(data: bytes) -> tuple[list[int], list[int], list[int], bytes | None]:
    """Types in order, supported groups, point formats, and the first server name."""
    r, types, curves, formats, name = _Reader(data), [], [], [], None
    while r.at < len(data):
        kind, body = r.uint(2), _Reader(r.take(r.uint(2)))
        types.append(kind)
        if kind == 10:
            curves += body.list_of(body.uint(2), 2)
        elif kind == 11:
            formats += body.list_of(body.uint(1), 1)
        elif kind == 0 and name is None and body.data:
            body.uint(2)
            body.uint(1)
            name = body.take(body.uint(2))
    return types, curves, formats, name


def parse_hello(body: bytes, client: bool) -> tuple:
    """(version, ciphers, extensions, curves, point formats, server name, bad extensions)"""
    r = _Reader(body)
    version = r.uint(2)
    r.take(32)
    r.take(r.uint(1))
    ciphers = r.list_of(r.uint(2), 2) if client else [r.uint(2)]
    r.take(r.uint(1) if client else 1)
    raw = r.take(r.uint(2)) if r.at < len(body) else b""
    try:
        return (version, ciphers, *_extensions(raw), False)
    except IndexError:
        return (version, ciphers, [], [], [], None, True)


def hellos(routed: DataFrame) -> DataFrame:
    """Rows of ``SCHEMA``: client, server, error, truncated, overflow, saturated."""

    def run(key: tuple, chunks: Iterator[dict]) -> Iterator[tuple]:
        held, carried = {CLIENT: b"", SERVER: b""}, {CLIENT: b"", SERVER: b""}
        seen: set[str] = set()
        for c in chunks:
            if len(seen) == 2:
                break
            way = c["direction"]
            sub = 1000 * c["sub"]

            def row(what, *rest, c=c):
                nonlocal sub
                sub += 1
                return (*key, c["ip_idx"], sub, c["ts"], what, *(rest or [None] * 6))

            room = BUFFER - len(held[way])
            if len(c["data"]) > room:
                yield row("saturated")
            held[way] += c["data"][:room]
            while len(held[way]) >= 5:
                buffer = held[way]
                size = int.from_bytes(buffer[3:5], "big")
                if size > MOST_RECORD:
                    held[way] = b""
                    yield row("error")
                    yield row("truncated")
                    break
                if len(buffer) < 5 + size:
                    break
                held[way] = buffer[5 + size :]
                if buffer[0] != HANDSHAKE or way in seen:
                    continue
                carried[way] += buffer[5 : 5 + size]
                if len(carried[way]) > BUFFER:
                    carried[way] = b""
                    yield row("overflow")
                while len(carried[way]) >= 4:
                    message = carried[way]
                    length = int.from_bytes(message[1:4], "big")
                    if length > BUFFER:
                        carried[way] = b""
                        yield row("overflow")
                        break
                    if len(message) < 4 + length:
                        break
                    carried[way] = message[4 + length :]
                    wanted = CLIENT_HELLO if way == CLIENT else SERVER_HELLO
                    if message[0] != wanted or way in seen:
                        continue
                    try:
                        *fields, bad = parse_hello(message[4 : 4 + length], way == CLIENT)
                    except IndexError:
                        yield row("error")
                        continue
                    if bad:
                        yield row("error")
                    seen.add(way)
                    yield row("client" if way == CLIENT else "server", *fields)

    mine = routed.where("route = 'Tls'").select(*KEY, "inst", "ip_idx", "sub", "ts", "direction", "data")
    return ordered_map(mine, [*KEY, "inst"], ["ip_idx", "sub"], run, SCHEMA)


def no_grease(values: Column, reserved: Collection[int] | None = None) -> Column:
    """Without ``reserved`` values; None: those of the form 0x?A?A, the halves not necessarily equal."""
    if reserved is not None:
        return F.filter(values, lambda v: ~v.isin(*reserved))
    return F.filter(values, lambda v: v.bitwiseAND(F.lit(0x0F0F)) != 0x0A0A)


def _dashed(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), "-")


def ja3(version: Column, ciphers: Column, extensions: Column, curves: Column, formats: Column, reserved: Collection[int] | None = None) -> Column:
    """The text whose MD5 is the client's fingerprint; ``reserved`` as in :func:`no_grease`."""
    return F.concat_ws(",", version.cast("string"), *[_dashed(no_grease(x, reserved)) for x in (ciphers, extensions, curves)], _dashed(formats))


def ja3s(version: Column, cipher: Column, extensions: Column, reserved: Collection[int] | None = None) -> Column:
    return F.concat_ws(",", version.cast("string"), cipher.cast("string"), _dashed(no_grease(extensions, reserved)))


#: Registered names; any other suite is shown as 0x....
CIPHERS = suites()
EVIDENCE = 64


def cipher_names(values: Column) -> Column:
    """Names of a list of suites. The registry is too large for a literal in generated code, so Arrow batches look it up."""

    def each(column: pa.Array) -> pa.Array:
        return pa.array([None if row is None else [CIPHERS.get(v, f"0x{v:04x}") for v in row] for row in column.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(each, "array<string>")(values.cast("array<bigint>"))


def cipher_name(value: Column) -> Column:
    return F.when(value.isNotNull(), F.get(cipher_names(F.array(F.coalesce(value, F.lit(0)))), F.lit(0)))


def is_weak(name: Column, server: bool = False) -> Column:
    return F.upper(name).rlike("NULL|ANON|EXPORT" + "|RC4" * server)


def sni_kind(sni: Column) -> Column:
    text = sni.cast("string")
    return F.when(sni.isNull(), None).when(~F.is_valid_utf8(text), "non-utf8").when(text.rlike(r"[^\x00-\x7F]"), "non-ascii").when(text.rlike(r"[\x00-\x1F\x7F]"), "control").otherwise("ascii")


def sni_key(sni: Column) -> Column:
    """The name under which a server name is counted."""
    return F.when(sni_kind(sni) == "non-utf8", F.concat(F.lit("<non-utf8:"), hex_of(sni), F.lit(">"))).otherwise(sni.cast("string"))


def version_name(version: Column) -> Column:
    return F.when(version == 0x0200, "SSL 2.0").when(version == 0x0300, "SSL 3.0").otherwise("Unknown legacy SSL")


def detect(found: DataFrame) -> DataFrame:
    """Findings in the rows of :func:`hellos`."""
    client, server, version, sni = F.col("what") == "client", F.col("what") == "server", F.col("version"), F.col("sni")
    kind, text = sni_kind(sni), F.make_valid_utf8(sni.cast("string"))
    raw = F.array(F.concat(F.lit("hex: "), hex_of(sni)))
    names = F.col("_names")
    weak = F.filter(names, lambda n: is_weak(n))
    shown = F.when(F.size(weak) > EVIDENCE, F.concat(F.slice(weak, 1, EVIDENCE), F.array(F.concat(F.lit("(+"), (F.size(weak) - EVIDENCE).cast("string"), F.lit(" more)"))))).otherwise(weak)
    chosen = F.get("_names", F.lit(0))
    code = F.lower(F.concat(F.lit("0x"), F.lpad(F.hex(F.get("ciphers", F.lit(0))), 4, "0")))
    old = F.concat(F.lit(" deprecated protocol ("), version_name(version), F.lit(", RFC 7568 prohibits SSLv3)"))
    old_seen = F.array(F.concat(F.lit("Version: "), F.lower(F.concat(F.lit("0x"), F.lpad(F.hex(version), 4, "0"))), F.lit(" ("), version_name(version), F.lit(")")))
    clause = F.when(text.rlike(r"[\x00-\x1F\x7F]"), " and ASCII control bytes").otherwise("")
    control = F.lit("TLS SNI contains ASCII control characters (RFC 6066 §3 requires ASCII; DNS preferred hostname syntax per RFC 952 / RFC 1123 restricts to letters, digits, and hyphens): ")
    low = lambda summary, sub: finding("Anomaly", "Inconclusive", "Low", summary, raw, ["T1027"], sub, direction=CLIENT)
    found = found.withColumn("_names", cipher_names(F.col("ciphers")))
    return rows(found, 3, F.col("at") * 1_000_000 + F.col("sub"), F.col("ts"), [
        (client & (kind == "control"), low(F.concat(control, text), 1)),
        (client & (kind == "non-ascii"), low(F.concat(F.lit("TLS SNI contains non-ASCII characters"), clause, F.lit(" (RFC 6066 requires A-labels per RFC 5890): "), text), 1)),
        (client & (kind == "non-utf8"), low(F.concat(F.lit("TLS SNI contains non-UTF-8 bytes (RFC 6066 violation): "), text), 1)),
        (client & (F.size(weak) > 0), finding("Anomaly", "Likely", "High", F.lit("ClientHello offers weak cipher suites (NULL/anonymous/export)"), shown, [], 2, direction=CLIENT)),
        (client & (version <= 0x0300), finding("Anomaly", "Likely", "High", F.concat(F.lit("ClientHello uses"), old), old_seen, [], 3, direction=CLIENT)),
        (server & is_weak(chosen, True), finding("Anomaly", "Likely", "Medium", F.concat(F.lit("ServerHello selected weak cipher suite ("), chosen, F.lit(")")), F.array(F.concat(F.lit("Selected cipher: "), chosen, F.lit(" ("), code, F.lit(")"))), [], 4, direction=SERVER)),
        (server & (version <= 0x0300), finding("Anomaly", "Likely", "High", F.concat(F.lit("ServerHello negotiated"), old), old_seen, [], 5, direction=SERVER)),
    ])


def fingerprints(found: DataFrame, reserved: Collection[int] | None = None) -> DataFrame:
    """``at``, ``ja3`` or ``ja3s`` and their MD5 of each hello; ``reserved`` as in :func:`no_grease`."""
    text = F.when(F.col("what") == "client", ja3(F.col("version"), F.col("ciphers"), F.col("extensions"), F.col("curves"), F.col("point_formats"), reserved)).when(F.col("what") == "server", ja3s(F.col("version"), F.get("ciphers", F.lit(0)), F.col("extensions"), reserved))
    return found.where(F.col("what").isin("client", "server")).select("at", "sub", "what", text.alias("text"), F.md5(text.cast("binary")).alias("hash"))


def counts(found: DataFrame, most: int | None = MOST_KEYS, reserved: Collection[int] | None = None) -> DataFrame:
    """``field``, ``value``, ``n``: every counter of the summary, one row for each value; ``most`` as in :func:`first_keys`, ``reserved`` as in :func:`no_grease`."""
    hello = found.where(F.col("what").isin("client", "server"))
    prints = fingerprints(found, reserved).select("at", "sub", F.when(F.col("what") == "client", "ja3_hashes").otherwise("ja3s_hashes").alias("field"), F.col("hash").alias("value"))
    versions = hello.select("at", "sub", F.lit("tls_versions").alias("field"), F.col("version").cast("string").alias("value"))
    chosen = found.where("what = 'server'").select("at", "sub", F.lit("cipher_suites").alias("field"), cipher_name(F.get("ciphers", F.lit(0))).alias("value"))
    names = found.where("what = 'client' AND sni IS NOT NULL").select("at", "sub", F.lit("snis").alias("field"), sni_key(F.col("sni")).alias("value"))
    labels = F.create_map(*[F.lit(x) for x in ("client", "handshakes", "error", "parse_errors", "truncated", "truncated_records", "overflow", "handshake_reassembly_overflows", "saturated", "buffer_saturation_drops")])
    events = found.where("what <> 'server'").select(F.lit("counters").alias("field"), labels[F.col("what")].alias("value"))
    values = first_keys(prints.unionByName(versions).unionByName(chosen).unionByName(names), ["at", "sub"], most)
    return values.unionByName(events.groupBy("field", "value").agg(F.count("*").alias("n")))
