"""Media columns in content-defined chunks.

A payload is stored as samples of an 8-bit mono WAV file. A gear hash over the last 32
bytes cuts the file into chunks where its high bits are zero, so equal passages give
equal chunks wherever they stand. Chunks that occur more than once are found by their
digests and stored once, in a table of shared chunks; the others stay with their medium.
Each medium is a row with the ordered list of its chunks, and is put together again,
verified against its digest, and read for features.

Which digests occur more than once is handed to the writing tasks as a Bloom filter of
fixed size. A digest that it takes for shared by mistake only goes to the shared table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .scratch import new_path, stage
from .skew import join_hot

UNIT = 192
RATE = 8000
SHORTEST, MASK_BITS, LONGEST = 1024, 12, 32768
_GEAR = np.random.default_rng(17).integers(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)
#: The Bloom filter has 2 ** BLOOM_BITS bits (4 MiB) whatever the input.
BLOOM_BITS, BLOOM_KEYS = 25, 4


def padded(text: bytes) -> bytes:
    """Spaces up to a positive multiple of ``UNIT``."""
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def wav(payload: bytes) -> bytes:
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def wav_payload(media: bytes) -> bytes:
    kind, _, form, _, _, code, channels, _, _, _, bits, _, n = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:44])
    if (kind, form, code, channels, bits) != (b"RIFF", b"WAVE", 1, 1, 8) or len(media) != 44 + n:
        raise ValueError("not an 8-bit mono WAV file")
    return media[44:]


def cuts(data: bytes) -> list[int]:
    """The ends of the chunks: after a byte where the gear hash's highest ``MASK_BITS`` bits are zero.

    hash = hash * 2 + gear[byte] modulo 2 ** 32, so a byte counts for 32 positions, and
    the highest bits depend on all of them. The sum is built by doubling, for all
    positions at once.
    """
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in range(5):
        step = 1 << k
        h[step:] += h[:-step] << np.uint32(step)
    marks = np.flatnonzero(h < np.uint32(1 << (32 - MASK_BITS))) + 1
    out, last, n = [], 0, len(data)
    for end in [*marks.tolist(), n]:
        while end - last > LONGEST:
            last += LONGEST
            out.append(last)
        if end - last >= SHORTEST or end == n:
            if end > last:
                out.append(end)
            last = end
    return out


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big")


def _bloom_bits(keys: np.ndarray) -> np.ndarray:
    return np.stack([(textnum.mixed(keys + np.uint64(k)) >> np.uint64(64 - BLOOM_BITS)).astype(np.int64) for k in range(BLOOM_KEYS)])


def feature(payload: bytes) -> str:
    """Mean, root mean square about the middle, zero crossings and spectral centroid of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    frames = x[: len(x) // UNIT * UNIT].reshape(-1, UNIT).sum(axis=0)
    return f"mean={int(x.sum()) * 1000 // len(x)};power={int((x * x).sum()) // len(x)};crossings={crossings};frame={int(np.argmax(frames))}"


def shared_digests(docs: DataFrame) -> DataFrame:
    """``key`` (long) of each chunk digest that occurs more than once. No chunk's bytes are shuffled."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in textnum.pieces(batch.column("text")):
                out = [_key(hashlib.sha256(c).digest()) for t in part.to_pylist() for c in chunks(wav(padded((t or "").encode())))]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(out, np.uint64).view(np.int64))], ["key"])

    keys = docs.mapInArrow(digests, "key long")
    return keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")


def bloom(keys: DataFrame) -> np.ndarray:
    """The Bloom filter of ``keys`` as 64-bit words: bits are combined in Spark, and at most 2 ** 19 words return."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bloom_bits(batch.column("key").to_numpy().view(np.uint64)))
            masks = (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(masks)], ["word", "mask"])

    got = keys.mapInArrow(bits, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)
    words[got["word"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    return words


def store(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Write the media of all rows and return the tables (media, shared chunks).

    media: doc_id, row_id, n_bytes, media_sha256, digests (in order), places (of the shared
    chunks), own (the bytes of the others, by position; null for shared ones). shared:
    digest, bytes, one row for each digest. Null is an empty text; repeated rows are media of
    their own that share all chunks.
    """
    body = docs.select("doc_id", F.col(text).alias("text"))
    words = bloom(shared_digests(body))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in textnum.pieces(batch.column("text")):
                n, sha, lists, places, own, others = [], [], [], [], [], []
                for t in part.to_pylist():
                    raw = (t or "").encode()
                    media = wav(padded(raw))
                    cut = chunks(media)
                    digests = [hashlib.sha256(c).digest() for c in cut]
                    at = _bloom_bits(np.array([_key(d) for d in digests], np.uint64))
                    hit = ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=0)
                    n.append(len(raw))
                    sha.append(hashlib.sha256(media).hexdigest())
                    lists.append(digests)
                    places.append(np.flatnonzero(hit))
                    own.append([None if s else zlib.compress(c, 4) for c, s in zip(cut, hit.tolist(), strict=True)])
                    others.append([zlib.compress(c, 4) for c, s in zip(cut, hit.tolist(), strict=True) if s])
                lists_of = pa.list_(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(part)), pa.array(n, pa.int64()), pa.array(sha), pa.array(lists, lists_of), pa.array(places, pa.list_(pa.int32())), pa.array(own, lists_of), pa.array(others, lists_of)],
                    ["doc_id", "n_bytes", "media_sha256", "digests", "places", "own", "others"],
                )

    saved = body.mapInArrow(save, "doc_id long, n_bytes long, media_sha256 string, digests array<binary>, places array<int>, own array<binary>, others array<binary>")
    spark = docs.sparkSession
    media = stage(saved.withColumn("row_id", F.monotonically_increasing_id()), "media")
    # Of each shared digest the least (row, position) gives the bytes.
    listed = F.transform("places", lambda i: F.get("digests", i))
    refs = media.select("row_id", F.posexplode(listed).alias("place", "digest"))
    holder = refs.groupBy("digest").agg(F.min(F.struct("row_id", "place")).alias("h")).select("digest", "h.row_id", "h.place")
    mine = holder.groupBy("row_id").agg(F.collect_list(F.struct("place", "digest")).alias("mine"))
    given = media.where(F.size("places") > 0).select("row_id", "others").join(mine, "row_id")
    rows = given.select(F.explode(F.transform("mine", lambda m: F.struct(m["digest"].alias("digest"), F.get("others", m["place"]).alias("bytes")))).alias("c"))
    path = new_path(spark, "media-shared")
    rows.select("c.*").write.parquet(path)
    return media.drop("others"), spark.read.schema("digest binary, bytes binary").parquet(path)


def rebuild(media: DataFrame, shared: DataFrame, columns: str, derive) -> DataFrame:
    """``doc_id`` and what ``derive(media bytes)`` gives for each medium, put together from its chunks and verified.

    Media without shared chunks are read as they lie. Of the others, one for each list of
    chunks is put together: its shared chunks are fetched by digest, and its results
    go to all media with that list. A chunk that stands in more than one of 200 of all
    places, and the results of a medium that so many rows hold, are broadcast.
    """

    def join_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, fetched, sha = (batch.column(c).to_pylist() for c in ("own", "fetched", "media_sha256"))
            rows = []
            for pieces, more, want in zip(own, fetched, sha, strict=True):
                places = {m["place"]: m["bytes"] for m in more or ()}
                whole = b"".join(zlib.decompress(places[i] if c is None else c) for i, c in enumerate(pieces))
                if hashlib.sha256(whole).hexdigest() != want:
                    raise ValueError(f"chunks don't give the medium {want}")
                rows.append(derive(whole))
            keep = ["media_sha256"] + [c for c in ("doc_id", "n_bytes") if c in batch.schema.names]
            made = pa.Table.from_pylist(rows) if rows else None
            if made is not None:
                made = made.combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made.columns], [*keep, *made.schema.names])

    plain = media.where(F.size("places") == 0).select("doc_id", "n_bytes", "media_sha256", "own", F.lit(None).cast("array<struct<place:int,bytes:binary>>").alias("fetched"))
    done = plain.mapInArrow(join_chunks, f"media_sha256 string, doc_id long, n_bytes long, {columns}")

    mixed = media.where(F.size("places") > 0)
    one = stage(mixed.groupBy("media_sha256").agg(F.min("row_id").alias("row_id"), F.count("*").alias("rows")), "media-distinct")
    wanted = F.explode(F.transform("places", lambda i: F.struct(i.alias("place"), F.get("digests", i).alias("digest"))))
    refs = mixed.select("row_id", "digests", "places").join(one.select("row_id"), "row_id").select("row_id", wanted.alias("w")).select("row_id", "w.*")
    refs = stage(refs, "media-refs")
    counted = shared.join(refs.groupBy("digest").agg(F.count("*").alias("n")), "digest")
    fetched = join_hot(refs, counted, ["digest"], "n", 200).groupBy("row_id").agg(F.collect_list(F.struct("place", "bytes")).alias("fetched"))
    built = mixed.select("row_id", "media_sha256", "own").join(fetched, "row_id").select("media_sha256", "own", "fetched")
    built = stage(built.mapInArrow(join_chunks, f"media_sha256 string, {columns}"), "media-built")
    spread = join_hot(mixed.select("doc_id", "n_bytes", "media_sha256"), built.join(one.select("media_sha256", "rows"), "media_sha256"), ["media_sha256"], "rows", 200)
    return done.unionByName(spread)


def described(whole: bytes) -> dict:
    payload = wav_payload(whole)
    return {
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-16:]),
        "media_bytes": len(whole),
        "feature": feature(payload),
    }


DESCRIBED = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string"


def query(spark, sf_dir: str) -> DataFrame:
    media, shared = store(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    out = rebuild(media, shared, DESCRIBED, described)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
