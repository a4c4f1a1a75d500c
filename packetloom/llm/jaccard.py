"""Near-duplicate join on word shingles with Bayesian candidate pruning.

1. Each document becomes its set of five-word shingles, a key of that set, and MinHash
   values. Equal sets are one class.
2. Classes that agree on all MinHash values of some band are candidates; each is tied to
   the least class of its bucket, and components of these ties hold all candidates of a class.
3. Within a component, pairs are compared MinHash values first, some at a time. A pair
   goes as soon as the posterior probability that its similarity reaches the threshold,
   given the agreements so far, falls below a tolerance. The rest are verified exactly.

A component is compared in blocks of bounded size and leaves one row for each class and
block, never one for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum
from .components import connected_components
from .scratch import stage
from .skew import join_hot

#: 30 bands of 6 values: a pair of similarity 0.8 is missed with probability 0.0001, of 0.85 with 0.0000002.
BANDS, ROWS = 30, 6
VALUES = BANDS * ROWS
STEP = 12
_rng = np.random.default_rng(5)
_A = (_rng.integers(1, 2**32, VALUES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 2**32, VALUES, dtype=np.uint64).astype(np.uint32)
_BAND = _rng.integers(1, 2**63, (1, ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array, n: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each row's runs of ``n`` words, of all its words where they are fewer."""
    w = textnum.words(column)
    grams, doc = textnum.ngrams(w, n)
    at = np.searchsorted(doc, np.arange(len(column) + 1))
    count = np.diff(w.offsets)
    out = []
    for i in range(len(column)):
        if count[i] >= n:
            out.append(np.unique(grams[at[i] : at[i + 1]]))
        elif count[i]:
            own = w.hashes[w.offsets[i] : w.offsets[i + 1]]
            out.append(textnum.mixed((own * textnum._MULTIPLIERS[: len(own)]).sum(keepdims=True) + np.uint64(len(own))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Two sums over the hashes of each set: a key of 128 bits, as two columns."""
    return np.array([(int(s.sum()), int(textnum.mixed(s).sum())) for s in sets], np.uint64).view(np.int64).reshape(-1, 2)


def minhash(values: np.ndarray) -> np.ndarray:
    """``VALUES`` minima of a set's hashes, under as many linear maps of 32 bits."""
    low = (values >> np.uint64(32)).astype(np.uint32)
    best = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for first in range(0, len(low), 1024):
        part = low[None, first : first + 1024] * _A[:, None]
        part += _B[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return best


def bands(signature: np.ndarray) -> np.ndarray:
    mixed = textnum.mixed(signature.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1))
    keys = textnum.mixed((mixed * _BAND).sum(axis=1) + np.arange(BANDS, dtype=np.uint64))
    return keys.view(np.int64)


def least_agreements(threshold: float, tolerance: float) -> np.ndarray:
    """For each number of compared values, the fewest agreements with which a pair stays.

    The similarity has a uniform prior; given m agreements of n its posterior is
    Beta(m + 1, n - m + 1). A pair goes where P(similarity >= threshold) < tolerance.
    """
    least = np.zeros(VALUES + 1, np.int64)
    for n in range(STEP, VALUES + 1, STEP):
        # P(Beta(m+1, n-m+1) >= t) is P(Binomial(n+1, t) <= m).
        below, m = 0.0, 0
        for k in range(n + 1):
            below += math.exp(math.lgamma(n + 2) - math.lgamma(k + 1) - math.lgamma(n + 2 - k) + k * math.log(threshold) + (n + 1 - k) * math.log1p(-threshold))
            if below >= tolerance:
                m = k
                break
        least[n] = m
    return least


def agreeing_pairs(left: np.ndarray, right: np.ndarray, own: bool, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that survive the incremental comparison of MinHash values."""
    found_i, found_j = [], []
    columns = np.ascontiguousarray(right.T)
    for i in range(len(left)):
        j = np.arange(i + 1 if own else 0, len(right))
        same = np.zeros(len(j), np.int16)
        for n in range(STEP, VALUES + 1, STEP):
            if not len(j):
                break
            for k in range(n - STEP, n):
                same += columns[k, j] == left[i, k]
            stay = same >= least[n]
            if not stay.all():
                j, same = j[stay], same[stay]
        found_i.append(np.full(len(j), i))
        found_j.append(j)
    return np.concatenate(found_i or [np.zeros(0, int)]), np.concatenate(found_j or [np.zeros(0, int)])


def verified(sets_l: list[np.ndarray], sets_r: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs, sorted by i, reach the threshold exactly."""
    good = np.zeros(len(i), bool)
    for run in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1) if len(i) else []:
        own = sets_l[i[run[0]]]
        for first in range(0, len(run), 256):
            part = run[first : first + 256]
            others = [sets_r[k] for k in j[part]]
            size = np.array([len(x) for x in others])
            both = np.concatenate(others)
            spot = np.minimum(np.searchsorted(own, both), len(own) - 1)
            shared = np.add.reduceat((own[spot] == both).astype(np.int64), np.cumsum(size) - size)
            good[part] = shared >= threshold * (len(own) + size - shared) - 1e-9
    return good


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index of each of ``n`` nodes' components."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_duplicates(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, tolerance: float = 1e-6, block: int = 256, block_shingles: int = 2_000_000) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, n_links, copies.

    ``class_id`` is the least doc_id among the documents that links join, over any
    number of steps. ``n_links`` counts the other documents whose shingle sets have a
    Jaccard similarity of at least ``threshold``, copies among them; ``copies`` the
    documents with an equal set, the row itself too.

    A text without words (null, empty, spaces) links to nothing and is its own class. A
    text of fewer than ``shingle`` words is one shingle. Repeated rows are copies of each
    other; different texts under one doc_id are documents of their own. Rows without
    doc_id are linked to nothing and have a null class. No other column matters.
    """
    return _grouped(docs, threshold, shingle, tolerance, block, block_shingles).select("doc_id", "class_id", "n_links", "copies")


def deduplicated(docs: DataFrame, **limits) -> DataFrame:
    """All columns of one row of ``docs`` for each group of near duplicates.

    It is a row with the least doc_id of the group, of several texts under that id the
    one with the least hash, of its repeated rows one. A text without words and a row
    without doc_id have no near duplicates, so each of them stays, but of repeated rows
    with a doc_id one. ``limits``: those of :func:`near_duplicates`.
    """
    kept = _grouped(docs, **limits).where("kept").select("doc_id", "text_key").distinct()
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", _text_key())
    found = row.where("doc_id IS NOT NULL").join(kept, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    return found.select("row").unionByName(row.where("doc_id IS NULL").select("row")).select("row.*")


def _text_key() -> Column:
    """Tells the texts under one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key")


def _grouped(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, tolerance: float = 1e-6, block: int = 256, block_shingles: int = 2_000_000) -> DataFrame:
    """doc_id, text_key, class_id, n_links, copies, and ``kept``: whether the row is its group's first."""
    body = docs.select("doc_id", "text", _text_key())

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in textnum.pieces(batch.column("text")):
                sets = shingle_sets(part, shingle)
                sums = set_keys(sets)
                marks = [bands(minhash(s)) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, len(part)) for c in ("doc_id", "text_key")), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.list_(pa.int64()))],
                    ["doc_id", "text_key", "k1", "k2", "size", "marks"],
                )

    drawn = stage(body.mapInArrow(sketch, "doc_id long, text_key long, k1 long, k2 long, size long, marks array<bigint>"), "jaccard-sketch")
    # A class is an equal set; its number in a written table names it from here on, as one doc_id may stand on several texts.
    classes = drawn.where("size > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2", "size").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.count("*").alias("copies"))
    classes = stage(classes.select("k1", "k2", "size", "rep.*", "copies", F.monotonically_increasing_id().alias("node")), "jaccard-classes")

    # One row of marks for each class: the first document's; its repeated rows carry the same.
    own = ["doc_id", "text_key"]
    marks = drawn.select(*own, "marks").join(classes.select(*own, "node"), own).dropDuplicates(["node"])
    banded = stage(marks.select("node", F.explode("marks").alias("band")), "jaccard-bands")
    least = banded.groupBy("band").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1").select("band", "first")
    ties = banded.join(least, "band").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    groups = connected_components(ties)  # node, label

    sized = groups.join(classes, "node")
    total = sized.groupBy("label").agg(F.count("*").alias("members"), F.sum("size").alias("shingles"))
    parts = F.ceil(F.greatest(F.col("members") / block, F.col("shingles") / block_shingles)).cast("int")
    planned = sized.join(total.select("label", parts.alias("parts")), "label")
    block_of = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("own")
    planned = planned.select("doc_id", "text_key", "node", "label", "copies", "parts", block_of)

    # Each text of a candidate goes to every pair of blocks that holds its own block.
    low, high = F.least("own", "other"), F.greatest("own", "other")
    needed = body.join(planned, own)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in textnum.pieces(batch.column("text")):
                sets = shingle_sets(part, shingle)
                rest = batch.slice(first, len(part)).drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([s.tobytes() for s in sets], pa.binary())], [*rest.schema.names, "grams"])

    lined = needed.select("text", "node", "label", "copies", "parts", "own").mapInArrow(gather, "node long, label long, copies long, parts int, own int, grams binary")
    spread = lined.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = spread.select("label", low.alias("low"), high.alias("high"), "own", "node", "copies", "grams")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = spread.repartition(tasks, "label", "low", "high").sortWithinPartitions("label", "low", "high", "own", "node")
    fewest = least_agreements(threshold, tolerance)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        key = None
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("label", "low", "high")], strict=True))
            rows = zip(*[batch.column(c).to_pylist() for c in ("own", "node", "copies", "grams")], strict=True)
            for now, row in zip(keys, rows, strict=True):
                if now != key:
                    if held:
                        yield solve(key, held)
                    key, held = now, []
                if not held or held[-1][:2] != row[:2]:  # repeated rows stand side by side
                    held.append(row)
        if held:
            yield solve(key, held)

    def solve(key: tuple[int, int, int], rows: list) -> pa.RecordBatch:
        label, lowest, highest = key
        ids = np.array([r[1] for r in rows], np.int64)
        copies = np.array([r[2] for r in rows], np.int64)
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        signs = np.stack([minhash(s) for s in sets])
        if lowest == highest:
            i, j = agreeing_pairs(signs, signs, True, fewest)
            good = verified(sets, sets, i, j, threshold)
        else:
            cut = sum(r[0] == lowest for r in rows)
            i, j = agreeing_pairs(signs[:cut], signs[cut:], False, fewest)
            good = verified(sets[:cut], sets[cut:], i, j, threshold)
            j = j + cut
        i, j = i[good], j[good]
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        root = ids[_roots(len(ids), i, j)]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(root), pa.array(links.astype(np.int64))], ["node", "root", "links"])

    solved = stage(spread.mapInArrow(compare, "node long, root long, links long"), "jaccard-solved")
    links = solved.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(solved.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    joined = classes.join(links, "node", "left").join(roots, "node", "left").withColumn("label", F.coalesce("label", "node"))
    joined = stage(joined.select("k1", "k2", "size", *own, "label", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies"), "jaccard-joined")
    firsts = joined.groupBy("label").agg(F.min(F.struct(*own)).alias("first"))
    final = joined.join(firsts, "label").select("k1", "k2", "size", F.col("first.doc_id").alias("class_id"), F.col("first.text_key").alias("first_key"), "n_links", "copies")
    # Equal sets that a large share of the documents have are broadcast to them.
    met = join_hot(drawn.where("size > 0 AND doc_id IS NOT NULL").drop("marks"), final.withColumn("rows", F.col("copies")), ["k1", "k2", "size"], "rows")
    met = met.withColumn("kept", (F.col("doc_id") == F.col("class_id")) & (F.col("text_key") == F.col("first_key")))
    alone = drawn.where("size = 0 OR doc_id IS NULL").withColumns({"class_id": F.col("doc_id"), "n_links": F.lit(0).cast("long"), "copies": F.lit(1).cast("long"), "kept": F.lit(True)})
    columns = ["doc_id", "text_key", "class_id", "n_links", "copies", "kept"]
    return met.select(*columns).unionByName(alone.select(*columns))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
