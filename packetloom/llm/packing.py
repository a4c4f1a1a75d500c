"""Best-two-fit packing of token pieces into sequences of fixed size.

Documents are tokenized in Arrow batches and cut where they are longer than a sequence.
Only the numbers of pieces of each length, a table of at most 2048 rows, decide how
bins are filled, so the plan is made on those: a bin is filled greedily with the largest
pieces that fit; then its smallest piece gives way to two unpacked ones that fill the
gap more tightly, if there are such. The same filling is used as often as the numbers
allow. Spark then deals the pieces of each length out to the planned places.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache, partial
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textnum
from .scratch import stage

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Runs of white space, as the tokenizer's pattern knows it, too long for that pattern, which goes back over them step by step.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
PIECE_COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: The id that ends each document.
_END = 0


@cache
def encoder(path: str, added: bool = False):
    """A function from a text to its ids by the byte-level vocabulary as ranks: the ids that its JSON file gives.

    With ``added``, the tokens that the JSON file beside it adds, as <|endoftext|>, are one
    id wherever they stand in a text; without, they are text like any other.

    A long run of white space is one word of the tokenizer's pattern, less its last character
    where text follows, and is encoded by itself.
    """
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {}
    if added:
        with open(path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    made = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    blanks = tiktoken.Encoding("blanks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    plain = partial(made.encode, allowed_special="all") if added else made.encode_ordinary
    ends = tuple(special)

    def encode(text: str) -> list[int]:
        out, at = [], 0
        for run in _BLANKS.finditer(text):
            end = run.end()
            if end < len(text) and not text.startswith(ends, end):
                end -= 1
            out += plain(text[at : run.start()])
            out += blanks.encode_ordinary(text[run.start() : end])
            at = end
        return out + plain(text[at:]) if at else plain(text)

    return encode


def tokenize_pieces(docs: DataFrame, size: int = 2048, text: str = "text", vocabulary: str | None = None, with_ids: bool = False, added: bool = False) -> DataFrame:
    """Pieces of the token ids of each row of ``docs``, whole texts, ``_END`` behind each.

    Returns doc_id, piece, start, length, ids_crc32 and, with ``with_ids``, ids (binary,
    little-endian unsigned 32-bit). Of a document longer than ``size`` the first piece
    takes what full pieces leave. Null is an empty text, of one id. Other columns don't matter.
    ``added``: see :func:`encoder`.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, added)
        for batch in batches:
            for first, part in textnum.pieces(batch.column("text"), 1 << 22):
                owner, place, start, length, crc, raw = [], [], [], [], [], []
                for i, body in enumerate(part.to_pylist(), first):
                    ids = np.array([*encode(body or ""), _END], "<u4")
                    head = len(ids) % size or size
                    for k, a in enumerate([0, *range(head, len(ids), size)]):
                        own = ids[a : head if k == 0 else a + size].tobytes()
                        owner.append(i)
                        place.append(k)
                        start.append(a)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            raw.append(own)
                columns = [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(place, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(raw, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(cut, PIECE_COLUMNS + ", ids binary" * with_ids)


def plan_bins(numbers: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Fillings as (how often, lengths) that use up ``numbers`` (pieces by length)."""
    left = {k: v for k, v in numbers.items() if v > 0}
    keys = sorted(left)
    out = []

    def largest(room: int, used: dict[int, int]) -> int:
        """The longest length of at most ``room`` with a piece left, or 0."""
        at = bisect_right(keys, room) - 1
        while at >= 0 and left[keys[at]] <= used.get(keys[at], 0):
            at -= 1
        return keys[at] if at >= 0 else 0

    while keys:
        bin_, used, gap = [], {}, size
        while x := largest(gap, used):
            bin_.append(x)
            used[x] = used.get(x, 0) + 1
            gap -= x
        if gap and len(bin_) > 1:
            smallest = bin_[-1]
            room, best = gap + smallest, (smallest, 0, 0)
            used[smallest] -= 1
            # two unpacked pieces a >= b: for each a the longest b that still fits
            at = bisect_right(keys, room - 1) - 1
            while at >= 0 and best[0] < room and 2 * keys[at] > best[0]:
                a = keys[at]
                at -= 1
                if left[a] <= used.get(a, 0):
                    continue
                used[a] = used.get(a, 0) + 1
                b = largest(min(a, room - a), used)
                used[a] -= 1
                if b and a + b > best[0]:
                    best = (a + b, a, b)
            if best[1]:
                bin_[-1:] = best[1:]
                used[best[1]] = used.get(best[1], 0) + 1
                used[best[2]] = used.get(best[2], 0) + 1
            else:
                used[smallest] += 1
        used = {k: v for k, v in used.items() if v}
        times = min(left[k] // v for k, v in used.items())
        for k, v in used.items():
            left[k] -= times * v
            if not left[k]:
                del left[k]
                keys.remove(k)
        out.append((times, bin_))
    return out


def pack(pieces: DataFrame, size: int = 2048, spread: int = 200_000) -> DataFrame:
    """``pieces`` (with doc_id, piece, length of 1 to ``size``) with sequence_id and offset.

    Sequences are filled from 0 without gaps. The pieces of a length are numbered in
    buckets by hash of about ``spread`` rows, behind the buckets before, so no length's
    pieces are sorted in one task. Repeated rows get places of their own. The driver
    sees the counts by length and sends out the fillings, at most ``size`` rows each.
    """
    n = pieces.count()
    buckets = max(8, -(-n // spread))
    key = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).alias("bucket")
    placed = pieces.withColumn("bucket", key)
    counts = placed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    starts = counts.select("length", "bucket", before.alias("before"))
    numbers = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}

    rows, base, taken = [], 0, dict.fromkeys(numbers, 0)
    for times, filling in plan_bins(numbers, size):
        offsets = [0, *accumulate(filling)]
        for length, offset in zip(filling, offsets, strict=False):
            rows.append((length, taken[length], taken[length] + times, base, offset))
            taken[length] += times
        base += times
    places = pieces.sparkSession.createDataFrame(rows or [(0, 0, 0, 0, 0)], "planned long, low long, high long, first long, offset long")
    # Each bucket gets the places that its numbers fall in; the fillings are bounded by the lengths, not by the data.
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1
    ranked = placed.withColumn("_rank", rank).join(starts, ["length", "bucket"]).withColumn("_rank", F.col("_rank") + F.col("before")).drop("bucket", "before")
    met = ranked.join(F.broadcast(places), (F.col("length") == F.col("planned")) & (F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high")))
    return met.withColumn("sequence_id", F.col("first") + F.col("_rank") - F.col("low")).drop("_rank", "planned", "low", "high", "first")


def pack_documents(docs: DataFrame, size: int = 2048, text: str = "text", vocabulary: str | None = None, added: bool = False) -> DataFrame:
    """Token pieces of all rows of ``docs`` with their places in sequences.

    Tokens are made once and only the pieces' lengths and checksums are written; take
    :func:`sequences` for the ids. Empty tables give no rows.
    """
    return pack(stage(tokenize_pieces(docs, size, text, vocabulary, added=added), "pieces"), size)


def sequences(docs: DataFrame, packed: DataFrame, size: int = 2048, text: str = "text", vocabulary: str | None = None, added: bool = False) -> DataFrame:
    """``sequence_id`` and ``ids`` (binary, all pieces in place) for documents with distinct ids."""
    own = tokenize_pieces(docs, size, text, vocabulary, with_ids=True, added=added).select("doc_id", "piece", "ids")
    met = packed.join(own, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return met.select("sequence_id", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"))


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), added=True)
