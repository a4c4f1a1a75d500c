"""Spans of pattern matches as DataFrame expressions.

``regexp_extract_all`` and ``split`` walk a text alike, so a match starts where the
lengths of the earlier pieces and matches end. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,ord:int,stop:bigint,kind:string,value:string>>"
WITH_UNITS = SPAN.replace("value:string", "value:string,unit:int,units:int")


def spans(text: Column, pattern: str, kind: str, order: int, present: Column | None = None, boundary: str | None = None) -> Column:
    """Leftmost non-overlapping matches of ``pattern``, which never matches the empty string.

    ``present``: a cheap condition without which there is no match. With ``boundary``, a
    pattern of the places where a word begins, spans also have ``unit``, the number of the
    word they begin in (two stand before the text), and ``units``, how many they touch.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    kept = SPAN if boundary is None else WITH_UNITS

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["match"])
        span = [start.alias("start"), F.lit(order).alias("ord"), stop.alias("stop"), F.lit(kind).alias("kind"), x["match"].alias("value")]
        count = acc["count"]
        if boundary is not None:
            # A match begins and ends with no white space, so the words of gap and match can be counted apart.
            front = F.concat(F.when(acc["at"] == 0, " ").otherwise(""), x["gap"], F.lit("x"))
            begins, inside = F.regexp_count(front, F.lit(boundary)), F.regexp_count(x["match"], F.lit(boundary))
            count = acc["count"] + begins + inside
            span += [(acc["count"] + begins).alias("unit"), (inside + 1).alias("units")]
        return F.struct(stop.alias("at"), count.alias("count"), F.concat(acc["found"], F.array(F.struct(*span))).alias("found"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(1).alias("count"), F.array().cast(kept).alias("found"))
    found = F.aggregate(pairs, zero, step, lambda acc: acc["found"])
    if present is None:
        present = text.rlike(pattern)
    return F.when(present, found).otherwise(F.array().cast(kept))


def text_of(found: Column) -> Column:
    """``kind:start:end`` by start, then the kinds' order, joined by commas."""
    return F.array_join(F.transform(F.sort_array(found), lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))), ",")
