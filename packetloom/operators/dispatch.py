"""Protocol of a stream: by its first bytes before its ports, fixed by the first chunk that tells."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tokens that open an HTTP message, and the ports that stand in for content.
HTTP_TOKENS = (b"GET ", b"POST ", b"PUT ", b"DELETE ", b"HEAD ", b"OPTIONS ", b"PATCH ", b"CONNECT ", b"TRACE ", b"HTTP/")
PORTS = (((443, 8443), "Tls"), ((80, 8080), "Http"), ((502,), "Modbus"), ((20000,), "Dnp3"), ((44818,), "Enip"))
ATTEMPTS = 8


def classify_bytes(data: bytes, lower_port: int, upper_port: int, more: Iterable[tuple[str, Callable[[bytes, int, int], bool]]] = ()) -> str | None:
    """Tls, Http, Modbus, Dnp3, Enip, one of ``more`` (name and test), or None: the protocol that a chunk tells."""
    if len(data) >= 5 and data[:2] == b"\x16\x03":
        return "Tls"
    if data.startswith(HTTP_TOKENS):
        return "Http"
    by_port = next((name for ports, name in PORTS if lower_port in ports or upper_port in ports), None)
    return by_port or next((name for name, test in more if test(data, lower_port, upper_port)), None)


def classify(data: Column, lower_port: Column, upper_port: Column) -> Column:
    """:func:`classify_bytes` of a column of first chunks."""

    def each(data: pa.Array, lower: pa.Array, upper: pa.Array) -> pa.Array:
        return pa.array([None if d is None else classify_bytes(d, a, b) for d, a, b in zip(data.to_pylist(), lower.to_pylist(), upper.to_pylist(), strict=True)], pa.string())

    return F.arrow_udf(each, "string")(data, lower_port, upper_port)


def dispatch(chunks: DataFrame) -> DataFrame:
    """Chunks that have a ``route``: reassembly fixes it with the first of an instance's first eight chunks that tells.

    Chunks before that one are dropped, as are all of an instance whose first eight tell nothing.
    """
    return chunks.where("route IS NOT NULL")
