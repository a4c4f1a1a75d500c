"""Byte ranges of large classic captures, so that many tasks read one file.

Records of a classic capture have no marks, so a range doesn't know where its first one
begins. Each range guesses by a chain of plausible record headers and walks on to the
first record beyond its end. Guesses are then held against where the range before ends:
the first range begins at a known place, so a chain of ranges that agree is exact. Ranges
that don't agree are walked again from where they should begin, until all do. Nothing is
taken from a file with an error in any range.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.scratch import new_path, stage

from .formats import CLASSIC, CaptureError, classic_header, open_store

HEADER, RECORD = 24, 16
_WINDOW = 4 << 20
#: Headers in a row that make a guess, and the longest record that one may announce.
_CHAIN, _LONGEST = 12, 1 << 18
RANGE = "file_seq int, path string, target string, size long, nth int, begin long, stop long, entry long, leave long, packets long, error string"


class FileWindow:
    """Bytes of an open file by offset, read a few MiB at a time."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.base, self.data = 0, b""

    def at(self, offset: int, n: int) -> bytes:
        """At most ``n`` bytes from ``offset``, fewer only at the file's end."""
        if not (self.base <= offset and offset + n <= self.base + len(self.data)):
            self.base, self.data = offset, self.file.read_at(min(max(n, _WINDOW), max(0, self.size - offset)), offset) if offset < self.size else b""
        return self.data[offset - self.base : offset - self.base + n]


def walk(window: FileWindow, at: int, stop: int, order: str) -> tuple[int, int]:
    """Where the first record at or beyond ``stop`` begins, and the number of records before it; raises CaptureError."""
    n, size, captured = 0, window.size, struct.Struct(f"{order}8xI4x")
    while at < stop:
        if at + RECORD > size:
            raise CaptureError("record header ends early")
        length = captured.unpack(window.at(at, RECORD))[0]
        at += RECORD + length
        if at > size:
            raise CaptureError("packet record ends early")
        n += 1
    return at, n


def guess(window: FileWindow, begin: int, stop: int, order: str, per_second: int) -> int | None:
    """The first place in a range from which a chain of plausible records begins, if there is one."""
    for base in range(begin, stop, _WINDOW - 64):
        data = window.at(base, min(_WINDOW, stop - base + 64))
        found = []
        for shift in range(4):
            words = np.frombuffer(data, f"{order}u4", max(0, (len(data) - shift) // 4), shift)
            if len(words) >= 4:
                fraction, captured, original = words[1:-2], words[2:-1], words[3:]
                fits = (fraction < per_second) & (captured <= _LONGEST) & (captured <= original) & (original <= 1 << 24) & (original > 0) & (words[:-3] > 0)
                found.append(np.flatnonzero(fits) * 4 + shift)
        for place in np.sort(np.concatenate(found)) if found else []:
            at = base + int(place)
            if at >= stop:
                return None
            if _plausible(window, at, order, per_second):
                return at
    return None


def _plausible(window: FileWindow, at: int, order: str, per_second: int) -> bool:
    """A chain of headers of one time, give or take a day, or such a chain up to the file's exact end."""
    first = None
    for _ in range(_CHAIN):
        if at == window.size:
            return first is not None
        head = window.at(at, RECORD)
        if len(head) < RECORD:
            return False
        secs, fraction, captured, original = struct.unpack(f"{order}IIII", head)
        first = secs if first is None else first
        if fraction >= per_second or captured > _LONGEST or captured > original or abs(secs - first) > 86_400:
            return False
        at += RECORD + captured
    return True


def _walked(r: dict, window: FileWindow, magic: bytes) -> dict:
    """A range with its entry, leave, packets and error; one with an ``entry`` is walked from there, one without from a guess."""
    order, per_usec = CLASSIC[magic]
    entry, leave, n, error = r["entry"], None, 0, None
    if entry is None:
        entry = HEADER if r["nth"] == 0 else guess(window, r["begin"], r["stop"], order, per_usec * 1_000_000)
    if entry is not None:
        try:
            if r["nth"] == 0:
                classic_header(window.at(4, 20), magic)
            leave, n = walk(window, entry, r["stop"], order)
        except CaptureError as e:
            error = str(e)
    return {**r, "entry": entry, "leave": leave, "packets": n, "error": error}


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of a file that follow one another share its window, so bytes are read once however short the ranges are."""
    for batch in batches:
        out = []
        for path, own in groupby(batch.to_pylist(), key=lambda r: r["path"]):
            own = list(own)
            fs, _ = open_store(own[0]["target"])
            with fs.open_input_file(path) as file:
                magic = file.read_at(4, 0)
                window = FileWindow(file, own[0]["size"])
                out += [_walked(r, window, magic) for r in own]
        yield pa.RecordBatch.from_pylist(out, schema=batch.schema)


def _dealt(ranges: DataFrame, count: int) -> DataFrame:
    """Ranges by tasks, at most four for each core; those of a task follow one another."""
    tasks = min(count, 4 * ranges.sparkSession.sparkContext.defaultParallelism)
    return ranges.repartitionByRange(tasks, "file_seq", "nth").sortWithinPartitions("file_seq", "nth")


def split_index(spark: SparkSession, files: list[tuple[int, str, str, int]], split_bytes: int) -> str:
    """Write the exact byte ranges of classic captures (file_seq, path, target, size); returns the table's path.

    Each range holds the records that begin in it: entry, leave, first (the number of its
    first packet) and packets. A file with an error anywhere has one row, with the error.
    """
    made = spark.createDataFrame(files, "file_seq int, path string, target string, size long")
    last = ((F.col("size") - 1) / split_bytes).cast("int")
    ranges = made.withColumn("nth", F.explode(F.sequence(F.lit(0), last))).withColumn("begin", F.col("nth").cast("long") * split_bytes)
    ranges = ranges.withColumn("stop", F.least("size", F.col("begin") + split_bytes))
    ranges = ranges.select("*", F.lit(None).cast("long").alias("entry"), F.lit(None).cast("long").alias("leave"), F.lit(0).cast("long").alias("packets"), F.lit(None).cast("string").alias("error"))
    count = sum((size - 1) // split_bytes + 1 for *_, size in files)
    by_file = Window.partitionBy("file_seq").orderBy("nth")
    ranges = stage(_dealt(ranges, count).mapInArrow(_walks, RANGE), "ranges")
    while True:
        due = F.when(F.col("nth") == 0, F.lit(HEADER)).otherwise(F.lag("leave").over(by_file))
        held = ranges.withColumn("due", due)
        # A range behind an error has no place to begin at, and doesn't matter.
        wrong = F.col("due").isNotNull() & ~F.col("entry").eqNullSafe(F.col("due"))
        again = stage(held.where(wrong).withColumn("entry", F.col("due")).drop("due"), "ranges-again")
        n = again.count()
        if not n:
            break
        ranges = stage(held.where(~wrong).drop("due").unionByName(_dealt(again, n).mapInArrow(_walks, RANGE)), "ranges")
    path = new_path(spark, "splits")
    first = F.coalesce(F.sum("packets").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    good = ranges.withColumn("first", first).withColumn("failed", F.first("error", ignorenulls=True).over(by_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    kept = good.where((F.col("failed").isNull() & (F.col("packets") > 0)) | (F.col("failed").isNotNull() & (F.col("nth") == 0)))
    kept.select("file_seq", "path", "target", "size", "nth", "entry", "leave", "first", "packets", F.col("failed").alias("error")).write.parquet(path)
    return path


@dataclass
class SplitRange:
    """Records of a classic capture from ``entry`` to ``leave``, the first of them number ``first``."""

    entry: int
    leave: int
    first: int


def packets(target: str, path: str, size: int, part: SplitRange) -> Iterator[tuple]:
    """(number, secs, usecs, datalink, data) of a range's records."""
    fs, _ = open_store(target)
    with fs.open_input_file(path) as file:
        window = FileWindow(file, size)
        magic = window.at(0, 4)
        order, per_usec = CLASSIC[magic]
        datalink = classic_header(window.at(4, 20), magic)
        head, at, nth = struct.Struct(f"{order}III4x"), part.entry, part.first
        while at < part.leave:
            secs, fraction, captured = head.unpack(window.at(at, RECORD))
            yield nth, secs, fraction // per_usec, datalink, window.at(at + RECORD, captured)
            at, nth = at + RECORD + captured, nth + 1


def joined(ranges: list[dict], most: int = 256) -> list[dict]:
    """Ranges in order, with neighbours of a file made one, so that about ``most`` are left of any number; none grows beyond 128 MiB for it."""
    share = min(sum((r["leave"] or 0) - (r["entry"] or 0) for r in ranges if not r["error"]) // most, 128 << 20)
    out: list[dict] = []
    for r in ranges:
        last = out[-1] if out else None
        if last and not last["error"] and not r["error"] and last["file_seq"] == r["file_seq"] and last["leave"] == r["entry"] and r["leave"] - last["entry"] <= share:
            out[-1] = {**last, "leave": r["leave"], "packets": last["packets"] + r["packets"]}
        else:
            out.append(r)
    return out


def read_index(table: str) -> list[dict]:
    """The rows of a table of :func:`split_index`, one for each range, for the planning of a scan."""
    import pyarrow.parquet as pq

    fs, path = open_store(table)
    return sorted(pq.read_table(path, filesystem=fs).to_pylist(), key=lambda r: (r["file_seq"], r["nth"]))
