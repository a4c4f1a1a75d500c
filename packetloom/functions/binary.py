"""Integers and text from binary columns, as Catalyst expressions.

A read past the end of the bytes gives null. Offsets may be columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Offset = int | Column


def _lit(x: Offset) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def part(data: Column, at: Offset, n: Offset) -> Column:
    """``n`` bytes from offset ``at`` (from 0), fewer at the end."""
    return F.substring(data, (_lit(at) + 1).cast("int"), _lit(n).cast("int"))


def uint_be(data: Column, at: Offset, n: int) -> Column:
    whole = F.conv(F.hex(part(data, at, n)), 16, 10).cast("long")
    return whole if n == 1 else F.when(F.octet_length(data) >= _lit(at) + n, whole)


def uint_le(data: Column, at: Offset, n: int) -> Column:
    total = uint_be(data, at, 1)
    for k in range(1, n):
        total = total + F.shiftleft(uint_be(data, _lit(at) + k, 1), 8 * k)
    return total


def u8(data: Column, at: Offset) -> Column:
    return uint_be(data, at, 1)


def has_bit(value: Column, mask: int) -> Column:
    return value.bitwiseAND(F.lit(mask).cast("long")) != 0


def hex_of(data: Column, sep: str = "") -> Column:
    """Lower-case hexadecimal digits, with ``sep`` between bytes."""
    plain = F.lower(F.hex(data))
    return F.regexp_replace(plain, "(..)(?!$)", f"$1{sep}") if sep else plain


def mac(data: Column) -> Column:
    return F.upper(hex_of(data, ":"))


def ipv4(data: Column) -> Column:
    return F.concat_ws(".", *[u8(data, i).cast("string") for i in range(4)])


def ipv6(data: Column) -> Column:
    """The usual short form: the first longest run of two or more zero groups becomes ``::``."""
    full = F.regexp_replace(F.regexp_replace(F.lower(F.hex(data)), "(....)(?!$)", "$1:"), "(^|:)0{1,3}", "$1")
    run = lambda n: rf"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?::|$)(.*)$"
    # the variable of a lambda holds the long form, so that it is computed once
    short = F.transform(F.array(full), lambda x: F.coalesce(*[F.when(x.rlike(run(n)), F.regexp_replace(x, run(n), "$1::$2")) for n in range(8, 1, -1)], x))
    mapped = F.concat(F.lit("::ffff:"), ipv4(part(data, 12, 4)))
    return F.when(F.hex(part(data, 0, 12)) == "00000000000000000000FFFF", mapped).otherwise(F.get(short, F.lit(0)))
