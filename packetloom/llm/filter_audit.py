"""How filters of a corpus interact: what each removes alone, after the others, and in every order.

Texts are scanned where they lie in Arrow buffers: byte classes and prefix sums count words,
capitals and symbols, sorted and verified word hashes count distinct words. Each document
becomes a mask of the filters it fails; orders of filters are then sums over 32 masks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
_IS_UPPER = np.zeros(256, bool)
_IS_UPPER[ord("A") : ord("Z") + 1] = True
_BEGINS_CHAR = (np.arange(256) & 0xC0) != 0x80


@dataclass(frozen=True)
class Limits:
    """A: fewer words. B: fewer distinct words in a hundred. C: more capitals in a hundred code points. D: any symbol."""

    min_words: int = 200
    min_distinct: int = 50
    max_upper: int = 3
    symbols: str = "#$%&*|"  # ASCII


def _same_bytes(w: textnum.Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words ``a[i]`` and ``b[i]``, of equal sizes, have equal bytes."""
    if not len(a):
        return np.zeros(0, bool)
    size = w.ends[a] - w.starts[a]
    firsts = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(firsts, size)
    equal = w.data[np.repeat(w.starts[a], size) + place] == w.data[np.repeat(w.starts[b], size) + place]
    return np.logical_and.reduceat(equal, firsts)


def distinct_words(w: textnum.Words, rows: int) -> np.ndarray:
    """The number of distinct words of each row.

    Hashes are sorted within rows and equal neighbours compared by bytes; a row in which two
    different words share a hash is counted by its words themselves.
    """
    keep = np.uint64(max(1, int(rows).bit_length()))
    key = (w.doc.astype(np.uint64) << (np.uint64(64) - keep)) | (w.hashes >> keep)
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order][1:] == key[order][:-1]) + 1
    a, b = order[again], order[again - 1]
    same = (w.ends[a] - w.starts[a]) == (w.ends[b] - w.starts[b])
    same[same] = _same_bytes(w, a[same], b[same])
    out = np.diff(w.offsets) - np.bincount(w.doc[a], minlength=rows)
    for row in np.unique(w.doc[a[~same]]):
        inside = range(w.offsets[row], w.offsets[row + 1])
        out[row] = len({w.data[w.starts[i] : w.ends[i]].tobytes() for i in inside})
    return out


def scan(column: pa.Array, limits: Limits = Limits()) -> tuple[np.ndarray, list[bytes]]:
    """Masks of the filters A to D that each row fails, and the SHA-256 of its bytes; null is empty."""
    masks, digests = np.zeros(len(column), np.int32), []
    is_symbol = np.zeros(256, bool)
    is_symbol[list(limits.symbols.encode())] = True
    for first, part in textnum.pieces(column):
        data, at = textnum.utf8(part)
        w = textnum.words(part)
        n_words, distinct = np.diff(w.offsets), distinct_words(w, len(part))

        def count(of: np.ndarray, data: np.ndarray = data, at: np.ndarray = at) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(of[data], dtype=np.int64)])
            return total[at[1:]] - total[at[:-1]]

        fails = [
            n_words < limits.min_words,
            100 * distinct < limits.min_distinct * n_words,
            100 * count(_IS_UPPER) > limits.max_upper * count(_BEGINS_CHAR),
            count(is_symbol) > 0,
        ]
        masks[first : first + len(part)] = sum(x.astype(np.int32) << k for k, x in enumerate(fails))
        whole = memoryview(data)
        digests += [hashlib.sha256(whole[at[i] : at[i + 1]]).digest() for i in range(len(part))]
    return masks, digests


def failures(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """``docs`` without the text, with ``mask`` (bit k: fails filter A, B, C or D) and ``digest``.

    New columns replace those of the same names. Null is an empty text, which fails A alone.
    """
    rest = [c for c in docs.columns if c.lower() not in {text.lower(), "mask", "digest"}]
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias("text"))

    def scanned(batches):
        for batch in batches:
            masks, digests = scan(batch.column(len(rest)), limits)
            columns = [batch.column(i) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(masks), pa.array(digests, pa.binary())], [*rest, "mask", "digest"])

    kept = [rows.schema[i] for i in range(len(rest))]
    return rows.mapInArrow(scanned, T.StructType([*kept, T.StructField("mask", T.IntegerType()), T.StructField("digest", T.BinaryType())]))


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """``part``, ``mask`` of all five filters, ``n``, ``n_good`` and ``n_toxic``: at most 32 rows of a part.

    A row fails E if a smaller doc_id of the whole table has an equal text (by SHA-256).
    Repeated rows under one doc_id are rows of their own, and don't fail E by each other;
    a null doc_id is neither smaller nor larger than any. A document counts as good or toxic
    if any of its labels says so. Rows of a text are counted before they meet, so a text
    that many rows share is a few rows of a task.
    """
    rows = docs.select("doc_id", "text", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    rows = failures(rows, "text", limits).groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    # Rows without doc_id have no labels; their digests deal them out.
    rows = rows.withColumn("key", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.xxhash64("doc_id")))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marks = marks.withColumn("key", F.xxhash64("doc_id")).withColumnRenamed("doc_id", "of")
    rows = rows.join(marks, (rows["key"] == marks["key"]) & (rows["doc_id"] == marks["of"]), "left").drop("of", "key")
    no = F.lit(False)
    rows = rows.select("doc_id", "part", "mask", "digest", "n", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    groups = rows.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null")
    )
    first = F.col("least") == F.min("least").over(Window.partitionBy("digest"))
    groups = groups.withColumn("stays", F.col("n_null") + F.when(first, F.col("n_least")).otherwise(0))
    both = F.array(F.struct(F.col("mask"), F.col("stays").alias("n")), F.struct((F.col("mask") + DUPLICATE).alias("mask"), (F.col("n") - F.col("stays")).alias("n")))
    split = groups.select("part", "good", "toxic", F.inline(both)).where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n_good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("n_toxic"))


def _orders() -> Column:
    """A struct for each order of the filters and each step: ``filter_order, step, bit`` and ``before``, the earlier filters."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            rows.append(f"struct('{''.join(order)}' AS filter_order, {step} AS step, {bit} AS bit, {before} AS before)")
            before |= bit
    return F.expr(f"array({', '.join(rows)})")


def interactions(counts: DataFrame) -> DataFrame:
    """What each filter does at each step of each order, from ``mask_counts``.

    A part's masks, at most 32, are a list in its row, from which all orders are summed;
    nothing is joined. ``shapley`` is the sum over all orders: a document that fails k
    filters is removed by each of them in a k-th part of the orders.
    """
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("masks"))
    steps = parts.select("part", "masks", F.inline(_orders()))

    def total(value, where) -> Column:
        return F.aggregate("masks", F.lit(0).cast("bigint"), lambda acc, m: acc + F.when(where(m["mask"]), value(m)).otherwise(0))

    bit, before = F.col("bit"), F.col("before")

    def fails(m: Column) -> Column:
        return m.bitwiseAND(bit) != 0

    def here(m: Column) -> Column:
        return fails(m) & (m.bitwiseAND(before) == 0)

    def n(m: Column) -> Column:
        return m["n"]

    all_orders = factorial(len(FILTERS))
    return steps.select(
        "part",
        "filter_order",
        "step",
        total(n, lambda m: m.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"),
        total(n, here).alias("removed"),
        total(n, lambda m: fails(m) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total(n, lambda m: m == bit).alias("unique_fails"),
        total(lambda m: m["n_good"], here).alias("good_lost"),
        total(lambda m: m["n_toxic"], here).alias("toxic_lost"),
        total(lambda m: m["n"] * (F.lit(all_orders) / F.bit_count(m["mask"])).cast("bigint"), fails).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """The audit of ``docs``: 600 rows for each value of ``part`` (null: the empty string), none for an empty table.

    Null and empty texts, texts of any length, repeated rows, null ids and further columns
    are treated as ``failures`` and ``mask_counts`` state.
    """
    return interactions(mask_counts(docs, labels, part, limits))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return filter_audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), f AS (
  SELECT doc_id, part, (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END)
       + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
       + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END)
       + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
       + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask
  FROM w
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS g, sum(coalesce(toxic, 0)) AS t FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask
), s AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS s(c, b)
), o AS (
  SELECT s1.c || s2.c || s3.c || s4.c || s5.c AS filter_order, [s1.b, s2.b, s3.b, s4.b, s5.b] AS bits
  FROM s s1, s s2, s s3, s s4, s s5 WHERE s1.b | s2.b | s3.b | s4.b | s5.b = 31
), steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS before FROM o, unnest([1, 2, 3, 4, 5]) AS u(step)
)
SELECT part, filter_order, step::INTEGER AS step,
       sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
       sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
       sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
       sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
       sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN g ELSE 0 END)::BIGINT AS good_lost,
       sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN t ELSE 0 END)::BIGINT AS toxic_lost,
       sum(CASE WHEN mask & bit <> 0 THEN n * (120 // bit_count(mask)) ELSE 0 END)::BIGINT AS shapley
FROM m, steps GROUP BY part, filter_order, step
"""
