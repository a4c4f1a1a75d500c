"""Table functions for SQL: stream framing as partitioned functions, and lists within frames.

After :func:`register`, for example::

    SELECT * FROM modbus_units(TABLE(chunks) PARTITION BY flow_id ORDER BY (ip_idx, sub))
    SELECT c.at, i.* FROM frames c, LATERAL cpf_items(substring(c.frame, 31)) i

``chunks``: ip_idx, sub, ts, direction and data of reassembled streams, with one column that tells
their flow instances apart. A partition's rows pass one at a time, in order, through the
same state machine as the operators use.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .enip import CARRY


def cpf_of(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Number, type and data of each item of the common packet format, up to the first that is cut off."""
    n, at = min(int.from_bytes(data[:2], "little"), CARRY // 4), 2
    for k in range(n if len(data) >= 2 else 0):
        size = int.from_bytes(data[at + 2 : at + 4], "little")
        if len(data) < at + 4 or len(data) < at + 4 + size:
            return
        yield k, int.from_bytes(data[at : at + 2], "little"), data[at + 4 : at + 4 + size]
        at += 4 + size


class CpfItems:
    def eval(self, data: bytes):
        if data is not None:
            yield from cpf_of(bytes(data))


class ModbusUnits:
    """Units of one flow instance, with their windows' counts and transactions."""

    def __init__(self):
        from .modbus import MOST_PENDING, Machine

        self.machine = Machine(MOST_PENDING)

    def eval(self, row):
        chunk = {c: row[c] for c in ("ip_idx", "sub", "ts", "direction", "data")}
        chunk["data"] = bytes(chunk["data"])
        for at, sub, ts, direction, what, adu, paired, burst, slow, failed, outcome, request_fc, seconds in self.machine.chunk(chunk):
            fields = (int.from_bytes(adu[:2], "big"), adu[6], adu[7]) if adu else (None, None, None)
            yield (at, sub, ts, direction, what, *fields, adu, *(w[2] if w else None for w in (paired, burst, slow, failed)), outcome, request_fc, seconds)


FUNCTIONS = {
    "cpf_items": (CpfItems, "nth int, type int, data binary"),
    "modbus_units": (
        ModbusUnits,
        "at long, sub int, ts long, direction string, what string, txn int, unit int, fc int, adu binary, paired_count long, burst_count long, slow_count long, failed_count long, outcome string, request_fc int, seconds long",
    ),
}


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    for name, (made, columns) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(made, returnType=columns))
