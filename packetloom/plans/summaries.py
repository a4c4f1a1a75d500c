"""Counters as the summary rows of analyzers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_row(wide: DataFrame, place: int, name: str, analyzed: str) -> DataFrame:
    """A one-row table of counters as a summary row."""
    return wide.select(F.lit(place).alias("place"), F.lit(name).alias("analyzer_name"), F.expr(analyzed).cast("long").alias("packets_analyzed"), F.to_json(F.struct(*sorted(wide.columns))).alias("detail"))


def json_fields(long: DataFrame, place: int, name: str, analyzed: str, wanted: tuple[str, ...], maps: tuple[str, ...] = (), top: dict[str, str] | None = None, lists: dict[str, Column] | None = None, nested: str = "") -> DataFrame:
    """Counters as rows (field, value, n) as a summary row.

    ``wanted``: counters at the top level, 0 where they have no row. ``maps``: fields that
    become maps, of at most ``http.MOST_KEYS`` values each. ``top``: fields and the names
    under which their twenty most frequent values are listed. ``lists``: more columns.
    ``nested``: a name to put all of it under.
    """
    columns = {c: F.coalesce(F.sum(F.when((F.col("field") == "counters") & (F.col("value") == c), F.col("n"))), F.lit(0)).alias(c) for c in wanted}
    entries = lambda f: F.collect_list(F.when(F.col("field") == f, F.struct("value", "n")))
    columns |= {f: F.map_from_entries(F.array_sort(entries(f))).alias(f) for f in maps}
    for f, shown in (top or {}).items():
        ranked = F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct((-F.col("n")).alias("rank"), "value"))))
        columns[shown] = F.transform(F.slice(ranked, 1, 20), lambda x: x["value"]).alias(shown)
    wide = long.agg(*columns.values()).withColumns(lists or {})
    body = F.struct(*sorted([*columns, *(lists or {})]))
    detail = F.to_json(F.struct(body.alias(nested)) if nested else body)
    return wide.select(F.lit(place).alias("place"), F.lit(name).alias("analyzer_name"), F.col(analyzed).cast("long").alias("packets_analyzed"), detail.alias("detail"))
