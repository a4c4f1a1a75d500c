"""Packet captures (pcap and pcapng) as a PySpark data source.

``spark.read.format("capture").load(path)`` gives one partition for each capture file of
a folder (its own files only, known by their first four bytes) or for one file.
``read_captures`` also splits large classic captures (see ``splits``), so one file is read by
many tasks; a pcapng file, whose blocks depend on those before them, is one task. A file
that can't be read gives a single row with ``error``; none of its packets count.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

from . import splits
from .formats import CLASSIC, MAX_PCAPNG, PCAPNG, CaptureError, Pcapng, classic_packets, magic_of, open_store

SCHEMA = "file_seq int, path string, pkt_idx long, ts_secs long, ts_usecs int, datalink int, data binary, is_pcapng boolean, skipped_blocks long, opb_skipped long, error string"


#: Packets of a file up to this size are held until its end is reached, so it is walked once.
HELD = 64 << 20
SPLIT = 128 << 20


@dataclass
class CaptureFile(InputPartition):
    seq: int
    path: str
    size: int
    target: str  # tells the store of the path
    part: splits.SplitRange | None = None  # of a file that many tasks read
    error: str | None = None  # known before the scan


def list_captures(targets: list[str]) -> list[tuple[int, str, str, int, bytes]]:
    """Number, path, target, size and magic of each file; files of a folder are looked at many at a time."""
    out = []
    for target in targets:
        fs, path = open_store(target)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(f"no such file or folder: {target}")
        folder = info.type != pafs.FileType.File
        found = [info] if not folder else sorted((f for f in fs.get_file_info(pafs.FileSelector(path, recursive=False)) if f.type == pafs.FileType.File), key=lambda f: f.path)
        with ThreadPoolExecutor(32) as pool:
            magics = list(pool.map(lambda f, fs=fs: magic_of(fs, f.path), found))
        out += [(f.path, target, f.size, m) for f, m in zip(found, magics, strict=True) if not folder or m in CLASSIC or m == PCAPNG]
    return [(i, *f) for i, f in enumerate(out)]


class CaptureReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.paths = options.get("paths", options.get("path", "")).split("\n")
        self.index = options.get("index")
        self.only: set[str] | None = None

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """An equality on ``path`` leaves the other files unread."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.only = ({f.value} if self.only is None else self.only & {f.value})
            else:
                yield f

    def partitions(self):
        split: dict[int, list[CaptureFile]] = {}
        for r in splits.joined(splits.read_index(self.index)) if self.index else []:
            part = None if r["error"] else splits.SplitRange(r["entry"], r["leave"], r["first"])
            split.setdefault(r["file_seq"], []).append(CaptureFile(r["file_seq"], r["path"], r["size"], r["target"], part, r["error"]))
        files = [f for seq, path, target, size, _ in list_captures(self.paths) for f in split.get(seq) or [CaptureFile(seq, path, size, target)]]
        return [f for f in files if self.only is None or f.path in self.only] or [CaptureFile(-1, "", 0, "")]

    def read(self, partition: CaptureFile):
        if partition.seq < 0:
            return
        head = (partition.seq, partition.path)
        if partition.part is not None:
            yield from _batches((*head, *p, False, 0, 0, None) for p in splits.packets(partition.target, partition.path, partition.size, partition.part))
            return
        # An error anywhere in a file takes back all its packets. Those of a small file
        # wait for its end; a large one is walked once for the verdict and again for the packets.
        walk, count, error, held = _Walk(partition), 0, partition.error, []
        keep = partition.size <= HELD
        if error is None:
            try:
                for p in walk:
                    count += 1
                    if keep:
                        held.append(p)
            except (CaptureError, struct.error) as e:
                error = str(e)
        tail = (walk.is_pcapng, walk.skipped, walk.opb) if error is None else (False, 0, 0)
        if error is not None or not count:
            yield _batch([(*head, -1, None, None, None, None, *tail, error)])
            return
        yield from _batches((*head, i, *p, *tail, None) for i, p in enumerate(held if keep else _Walk(partition)))


class _Walk:
    def __init__(self, part: CaptureFile):
        self.part = part
        self.is_pcapng, self.skipped, self.opb = False, 0, 0

    def __iter__(self) -> Iterator[tuple]:
        fs, _ = open_store(self.part.target)
        with fs.open_input_stream(self.part.path, compression=None, buffer_size=1 << 20) as stream:
            magic = stream.read(4)
            if magic == PCAPNG:
                if self.part.size > MAX_PCAPNG:
                    raise CaptureError("E-INP-014: pcapng file above 4 GiB")
                walk = Pcapng()
                self.is_pcapng = True
                yield from walk.packets(stream)
                self.skipped, self.opb = walk.skipped, walk.opb
            elif magic in CLASSIC:
                yield from classic_packets(stream, magic)
            else:
                raise CaptureError("unrecognized pcap magic")


_KINDS = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


def _batches(made: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for row in made:
        rows.append(row)
        size += 120 + len(row[6])
        if size > 8 << 20:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return CaptureReader(schema, self.options)


def read_captures(spark: SparkSession, *targets: str, split_bytes: int = SPLIT) -> DataFrame:
    """Rows of all capture files of the targets, in the order given and by name within a folder.

    Classic captures of more than ``split_bytes`` are read in ranges of that size.
    """
    spark.dataSource.register(CaptureSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    scan = spark.read.format("capture").option("paths", "\n".join(targets))
    large = [(seq, path, target, size) for seq, path, target, size, magic in list_captures(list(targets)) if magic in CLASSIC and size > split_bytes]
    if large:
        scan = scan.option("index", splits.split_index(spark, large, split_bytes))
    return scan.load()


def captures(raw: DataFrame) -> DataFrame:
    """One row for each file: packets, link type, skipped blocks, error."""
    from pyspark.sql import functions as F

    return raw.groupBy("file_seq", "path").agg(
        F.max("datalink").alias("datalink"),
        F.count_if(F.col("pkt_idx") >= 0).alias("packets"),
        F.max("skipped_blocks").alias("skipped_blocks"),
        F.max("opb_skipped").alias("opb_skipped"),
        F.max("is_pcapng").alias("is_pcapng"),
        F.max("error").alias("error"),
    )
