"""Event-anchored windows: the first event opens one, an event too late for it opens the next.

They are neither tumbling nor session windows. Time that runs backwards never opens a
window. An alert "once per window when the count passes n" is a filter on ``win_count``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import ordered_map


class Anchor:
    """The current window of one kind of event; see :func:`anchored_windows`."""

    __slots__ = ("count", "number", "restart_at", "start", "width")

    def __init__(self, width: int, restart_at: bool = False):
        self.width, self.restart_at = width, restart_at
        self.start, self.count, self.number = None, 0, -1

    def event(self, now: int) -> tuple[int, int, int, int]:
        """Number, start, count and elapsed time of the window that an event at ``now`` falls into."""
        if self.start is None or (not self.restart_at and now - self.start > self.width):
            self.start, self.count, self.number = now, 0, self.number + 1
        self.count += 1
        elapsed = max(0, now - self.start)
        out = self.number, self.start, self.count, elapsed
        if self.restart_at and elapsed >= self.width:
            self.start, self.count, self.number = now, 1, self.number + 1
        return out


#: Type of a window's column: its number, start, events so far and time since its start.
WINDOW = "struct<win_no:bigint,win_start:bigint,win_count:bigint,elapsed:bigint>"


def with_windows(df: DataFrame, keys: list[str], order: list[str], ts: str, windows: dict[str, tuple[Column, int]]) -> DataFrame:
    """``df`` with a column for each of several windows, all from one ordered pass over each key's rows.

    ``windows``: name to (whether a row is an event of it, width). A row that is none has null.
    """
    marked = df.withColumns({f"_{name}": F.coalesce(when, F.lit(False)) for name, (when, _) in windows.items()})
    widths = {name: width for name, (_, width) in windows.items()}
    kept = [f for f in df.schema.fields]
    schema = T.StructType([*kept, *[T.StructField(name, T._parse_datatype_string(WINDOW)) for name in windows]])

    def run(key: tuple, rows: Iterator[dict]) -> Iterator[tuple]:
        anchors = {name: Anchor(width) for name, width in widths.items()}
        for r in rows:
            yield (*[r[f.name] for f in kept], *[anchors[name].event(r[ts]) if r[f"_{name}"] else None for name in anchors])

    return ordered_map(marked, keys, order, run, schema)


def anchored_windows(events: DataFrame, keys: list[str], order: list[str], ts: str, width: int, restart_at: bool = False) -> DataFrame:
    """``keys``, ``order`` and the window of each event: win_no (from 0), win_start, win_count, elapsed.

    An event with ts - start > ``width`` opens a window with count 1. With
    ``restart_at`` a window ends with the event that is ``width`` or more behind its
    start: the event counts in it, and also is the first of the next.
    """
    kinds = dict(events.dtypes)
    lead = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, *order])

    def run(key: tuple, rows: Iterator[dict]) -> Iterator[tuple]:
        anchor = Anchor(width, restart_at)
        for r in rows:
            yield (*key, *[r[c] for c in order], *anchor.event(r[ts]))

    return ordered_map(events.select(*keys, *order, *[c for c in [ts] if c not in [*keys, *order]]), keys, order, run, f"{lead}, win_no long, win_start long, win_count long, elapsed long")


def first_in_window(windows: DataFrame, keys: list[str], order: list[str], condition) -> DataFrame:
    """Of each window the first event for which ``condition`` holds: a latch."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys, "win_no").orderBy(*order)
    return windows.where(condition).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
