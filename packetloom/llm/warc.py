"""WARC archives as a PySpark data source.

``spark.read.format("warc")`` plans one partition for each archive file, takes equality
and IN filters on header columns, reads a record's header lines first and passes over
the payload of a record that the filters rule out or whose payload nobody asks for.
``df.write.format("warc")`` writes one file for each task; files appear under their
final names only when the whole job commits. Paths may lie in any store that
``pyarrow.fs`` opens.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    In,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .scratch import new_path

VERSION = b"WARC/1.0"
#: Columns and the header fields that they come from.
FIELDS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "profile": "WARC-Profile",
    "full_length": "X-Full-Payload-Length",
}
SCHEMA = ", ".join(f"{c} string" for c in FIELDS) + ", content_length long, payload binary"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if urlsplit(path).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlsplit(path).path
    return pafs.FileSystem.from_uri(path)


def record(fields: dict[str, str], payload: bytes) -> bytes:
    """One record; header values have no line breaks."""
    lines = [VERSION, *[f"{k}: {' '.join(str(v).split())}".encode() for k, v in fields.items() if v is not None], b"Content-Length: %d" % len(payload)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def read_records(stream, wanted, with_payload: bool) -> Iterator[dict]:
    """Records of a stream whose header ``wanted`` accepts. Other payloads are passed over, not kept."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.partition(b":")
            fields[name.strip().decode().lower()] = value.strip().decode("utf-8", "replace")
        length = int(fields.get("content-length", 0))
        row = {c: fields.get(f.lower()) for c, f in FIELDS.items()} | {"content_length": length, "payload": None}
        if wanted(row) and with_payload:
            row["payload"] = stream.read(length)
            if len(row["payload"]) < length:
                raise ValueError("a WARC record ends early")
            yield row
        else:
            stream.seek(length, io.SEEK_CUR)
            if wanted(row):
                yield row


@dataclass
class ArchiveFile(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.path = schema.fieldNames(), options["path"]
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.filters: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name in FIELDS:
                self.filters.append((name, list(f.value) if isinstance(f, In) else [f.value]))
            else:
                yield f

    def partitions(self):
        fs, path = _store(self.path)
        info = fs.get_file_info(path)
        files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path))
        names = sorted(f.path for f in files if f.type == pafs.FileType.File and f.path.endswith((".warc", ".warc.gz")))
        return [ArchiveFile(p) for p in names] or [ArchiveFile("")]

    def read(self, partition: ArchiveFile):
        if not partition.path:
            return
        wanted = lambda row: all(row[c] in values for c, values in self.filters)
        fs, _ = _store(self.path)
        with fs.open_input_stream(partition.path, compression=None) as raw:
            stream = io.BufferedReader(_Gunzipped(raw), 1 << 16) if partition.path.endswith(".gz") else io.BufferedReader(_Plain(raw), 1 << 16)
            rows: list[dict] = []
            held = 0
            for row in read_records(_Skipping(stream), wanted, self.with_payload and "payload" in self.names):
                rows.append(row)
                held += 500 + len(row["payload"] or b"")
                if held > 8 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"content_length": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in self.names], self.names)


class _Plain(io.RawIOBase):
    def __init__(self, raw):
        self.raw_stream = raw

    def readable(self):
        return True

    def readinto(self, b):
        data = self.raw_stream.read(len(b))
        b[: len(data)] = data
        return len(data)


class _Gunzipped(io.RawIOBase):
    """The bytes of a file of gzip members, one for each record."""

    def __init__(self, raw):
        self.raw_stream, self.inflate, self.rest, self.out = raw, None, b"", b""

    def readable(self):
        return True

    def readinto(self, b):
        while not self.out:
            if not self.rest:
                self.rest = self.raw_stream.read(1 << 18)
                if not self.rest:
                    return 0
            if self.inflate is None:
                self.inflate = zlib.decompressobj(31)
            self.out = self.inflate.decompress(self.rest)
            self.rest = self.inflate.unused_data
            if self.inflate.eof:
                self.inflate = None
        n = min(len(b), len(self.out))
        b[:n], self.out = self.out[:n], self.out[n:]
        return n


class _Skipping:
    """``readline``, ``read``, and ``seek`` forward by reading and forgetting."""

    def __init__(self, stream: io.BufferedReader):
        self.readline, self.read, self.stream = stream.readline, stream.read, stream

    def seek(self, n: int, _whence: int) -> None:
        while n > 0:
            n -= len(self.stream.read(min(n, 1 << 16))) or n


@dataclass
class Written(WriterCommitMessage):
    path: str


class WarcWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict):
        self.path, self.gzip = options["path"], options.get("compression", "gzip") == "gzip"
        self.job = uuid.uuid4().hex

    def write(self, rows) -> Written:
        fs, path = _store(self.path)
        fs.create_dir(path, recursive=True)
        name = f"{path}/.{self.job}-{uuid.uuid4().hex}"  # each attempt has its own file
        with fs.open_output_stream(name, compression=None) as out:
            for r in rows:
                r = r.asDict()
                data = record({f: r.get(c) for c, f in FIELDS.items()}, bytes(r.get("payload") or b""))
                if self.gzip:
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = z.compress(data) + z.flush()
                out.write(data)
        return Written(name)

    def commit(self, messages) -> None:
        fs, path = _store(self.path)
        for i, m in enumerate(m for m in messages if m is not None):
            fs.move(m.path, f"{path}/part-{i:06d}-{self.job}.warc" + ".gz" * self.gzip)

    def abort(self, messages) -> None:
        fs, _ = _store(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.path)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the format known, and let Spark hand filters to Python sources."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of an archive file or of a folder's archives; without ``payload`` no payload is decoded."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_records(pages: DataFrame, min_bytes: int = 1000, salts: int = 32) -> DataFrame:
    """Records for crawled pages: equal payloads of at least ``min_bytes`` are stored once.

    The page with the largest page_id holds the response, others are revisits that
    refer to it. Null html is an empty payload, null page_ids never hold a response that
    others refer to, and repeated rows of the response's page_id are responses too.
    Digests are aggregated within tasks first; only those with several pages are joined
    back, on digest and salt, so a payload that a third of all pages share is no hot key.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    shared = rows.where(F.length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1")
    shared = shared.select("digest", "holder", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")).join(shared, ["digest", "salt"], "left")
    revisit = (F.col("holder") != F.col("page_id")) | (F.col("holder").isNotNull() & F.col("page_id").isNull())
    revisit = F.coalesce(revisit, F.lit(False))
    urn = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    return rows.select(
        F.coalesce(urn(F.col("page_id")), F.lit("urn:page:")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit("2024-01-01T00:00:00Z").alias("warc_date"),
        F.concat(F.lit("sha1:"), F.col("digest")).alias("payload_digest"),
        F.when(revisit, urn(F.col("holder"))).alias("refers_to"),
        F.when(revisit, REVISIT_PROFILE).alias("profile"),
        F.length("payload").cast("string").alias("full_length"),
        F.when(revisit, F.lit(0)).otherwise(F.length("payload")).cast("long").alias("content_length"),
        F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, path: str | None = None) -> str:
    """Write the records of ``pages`` as archives and return their folder."""
    path = path or new_path(pages.sparkSession, "warc")
    register(pages.sparkSession)
    page_records(pages).write.format("warc").mode("append").save(path)
    return path


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages as the archives hold them; lengths and digests of responses are taken from the payload read."""
    page = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast("long")
    response = F.col("record_type") == "response"
    kept = read_warc(spark, path).where(response)
    again = read_warc(spark, path, payload=False).where(F.col("record_type") == "revisit")
    return kept.select(
        page(F.col("record_id")).alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")
    ).unionByName(
        again.select(page(F.col("record_id")).alias("page_id"), F.col("full_length").cast("long").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", page(F.col("refers_to")).alias("refers_to"))
    )


def query(spark, sf_dir: str) -> DataFrame:
    return read_pages(spark, write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), h AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS holder FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN holder END AS refers_to
FROM h
"""
