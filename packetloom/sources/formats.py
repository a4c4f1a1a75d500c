"""The two formats of captures, pcap and pcapng, as streams of records."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow.fs as pafs

# Fixed values of the two formats.
CLASSIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
PCAPNG = b"\x0a\x0d\x0d\x0a"
LINK_TYPES = (1, 101, 113, 228, 229)
SHB, IDB, PB, SPB, EPB = 0x0A0D0D0A, 1, 2, 3, 6
MAX_PCAPNG = 4 << 30
MAX_INTERFACES = 65_535
MAX_SECS = 2**32 - 1


class CaptureError(ValueError):
    """A file that is no readable capture; the message says why."""


class Ticks:
    """Seconds and microseconds from a 64-bit count in units of ``if_tsresol``."""

    def __init__(self, resolution: int):
        self.units = 2 ** (resolution & 0x7F) if resolution & 0x80 else 10**resolution

    def split(self, high: int, low: int) -> tuple[int, int]:
        secs, rest = divmod((high << 32) | low, self.units)
        return min(secs, MAX_SECS), rest * 1_000_000 // self.units


def read_exactly(stream, n: int, what: str) -> bytes:
    data = stream.read(n)
    if len(data) < n:
        raise CaptureError(f"{what} ends early")
    return data


def classic_header(header: bytes, magic: bytes) -> int:
    """The link type from the 20 bytes behind the magic."""
    if len(header) < 20:
        raise CaptureError("file header ends early")
    datalink = struct.unpack(f"{CLASSIC[magic][0]}I", header[16:])[0] & 0x0FFFFFFF
    if datalink not in LINK_TYPES:
        raise CaptureError(f"unsupported link type {datalink}")
    return datalink


def classic_packets(stream, magic: bytes) -> Iterator[tuple]:
    """(secs, usecs, datalink, data) of a classic capture; records longer than the snap length stay."""
    order, per_usec = CLASSIC[magic]
    datalink = classic_header(stream.read(20), magic)
    while record := stream.read(16):
        if len(record) < 16:
            raise CaptureError("record header ends early")
        secs, fraction, captured, _ = struct.unpack(f"{order}IIII", record)
        yield secs, fraction // per_usec, datalink, read_exactly(stream, captured, "packet record")


def _options_resolution(body: bytes, order: str) -> int:
    """``if_tsresol`` (code 9) among the options of an interface block, 6 without it."""
    at, found = 8, 6
    while at + 4 <= len(body):
        code, size = struct.unpack(f"{order}HH", body[at : at + 4])
        if code == 0:
            break
        if at + 4 + size > len(body):
            raise CaptureError("E-INP-008: interface option runs past its block")
        if code == 9:
            if size != 1:
                raise CaptureError("E-INP-008: if_tsresol must be one byte")
            found = body[at + 4]
        at += 4 + size + (-size % 4)
    return found


class Pcapng:
    """The block walk of one pcapng file: an order-dependent interface table, so one task."""

    def __init__(self):
        self.order = None
        self.interfaces: list[Ticks] = []
        self.datalink = None
        self.seen_packet = False
        self.skipped = self.opb = 0

    def packets(self, stream) -> Iterator[tuple]:
        first = True
        while head := (PCAPNG + stream.read(4) if first else stream.read(8)):
            if len(head) < 8:
                raise CaptureError("E-INP-010: block header ends early")
            if head[:4] == PCAPNG:
                if not first:
                    raise CaptureError("E-INP-012: a second section is not supported")
                mark = read_exactly(stream, 4, "E-INP-010: section header")
                self.order = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}.get(mark)
                if self.order is None:
                    raise CaptureError("E-INP-008: bad byte-order magic")
                total = struct.unpack(f"{self.order}I", head[4:])[0]
                if total < 28 or total % 4:
                    raise CaptureError("E-INP-008: bad section header length")
                body = mark + read_exactly(stream, total - 16, "E-INP-010: section header")
                if struct.unpack(f"{self.order}H", body[4:6])[0] != 1:
                    raise CaptureError("E-INP-008: unsupported pcapng version")
                read_exactly(stream, 4, "E-INP-010: section header")
                first = False
                continue
            kind, total = struct.unpack(f"{self.order}II", head)
            if total < 12 or total % 4:
                raise CaptureError("E-INP-010: bad block length")
            body = read_exactly(stream, total - 12, "E-INP-010: block")
            if struct.unpack(f"{self.order}I", read_exactly(stream, 4, "E-INP-010: block"))[0] != total:
                raise CaptureError("E-INP-010: block lengths differ")
            if kind == IDB:
                self._interface(body)
            elif kind == EPB:
                yield self._enhanced(body)
            elif kind == SPB:
                yield self._simple(body)
            else:
                self.skipped += 1
                self.opb += kind == PB

    def _interface(self, body: bytes) -> None:
        # A description's own faults come first, then its place among the blocks.
        if len(body) < 8:
            raise CaptureError("E-INP-008: interface description too short")
        if body[2:4] != b"\0\0":
            raise CaptureError("E-INP-008: reserved field of an interface description is not zero")
        if self.seen_packet:
            raise CaptureError("E-INP-013: interface description after a packet")
        if len(self.interfaces) >= MAX_INTERFACES:
            raise CaptureError("E-INP-015: too many interfaces")
        link = struct.unpack(f"{self.order}H", body[:2])[0]
        if link not in LINK_TYPES:
            raise CaptureError(f"unsupported link type {link}")
        if self.datalink not in (None, link):
            raise CaptureError("E-INP-011: interfaces with different link types")
        self.datalink = link
        self.interfaces.append(Ticks(_options_resolution(body, self.order)))

    def _enhanced(self, body: bytes) -> tuple:
        if not self.interfaces:
            raise CaptureError("E-INP-009: packet before any interface description")
        if len(body) < 20:
            raise CaptureError("E-INP-008: packet block too short")
        at, high, low, captured, _ = struct.unpack(f"{self.order}IIIII", body[:20])
        if at >= len(self.interfaces):
            raise CaptureError("E-INP-010: unknown interface")
        if captured + (-captured % 4) > len(body) - 20:
            raise CaptureError("E-INP-008: packet data runs past its block")
        self.seen_packet = True
        return (*self.interfaces[at].split(high, low), self.datalink, body[20 : 20 + captured])

    def _simple(self, body: bytes) -> tuple:
        if not self.interfaces:
            raise CaptureError("E-INP-009: packet before any interface description")
        if len(body) < 4:
            raise CaptureError("E-INP-008: packet block too short")
        self.seen_packet = True
        size = min(struct.unpack(f"{self.order}I", body[:4])[0], len(body) - 4)
        return 0, 0, self.datalink, body[4 : 4 + size]


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    if urlsplit(path).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlsplit(path).path
    return pafs.FileSystem.from_uri(path)


def magic_of(fs: pafs.FileSystem, path: str) -> bytes:
    with fs.open_input_stream(path, compression=None) as f:
        return f.read(4)
