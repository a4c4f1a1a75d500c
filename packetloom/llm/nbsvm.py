"""Naive Bayes support vectors for document quality.

N-gram indicators are scaled by the log of the ratio of their smoothed frequencies in
the two classes; on them a linear model with hinge loss is fitted by dual coordinate
descent. The n-grams are words, and runs of one to three word shapes (letters, digits
and marks in the order in which they stand, and whether a word repeats the last one).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum

BITS = 18
#: Bytes to the letters of a shape: case, digits, and other marks as they are.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[128:] = ord("a")


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32, of the hashed n-grams: log ratio times the fitted weight
    bias: float
    slope: float  # of the score as a logistic function of the margin
    shift: float


def _shape_hashes(w: textnum.Words) -> np.ndarray:
    """A hash of each word's shape, runs of equal shape letters taken as one."""
    if not len(w.starts):
        return np.zeros(0, np.uint64)
    size = w.ends - w.starts
    firsts = np.cumsum(size) - size
    at = np.repeat(w.starts - firsts, size) + np.arange(int(size.sum()))
    shape = _SHAPE[w.data[at]]
    new = np.ones(len(shape), bool)
    new[1:] = shape[1:] != shape[:-1]
    new[firsts] = True
    rank = np.cumsum(new)
    place = rank - np.repeat(rank[firsts], size)
    value = np.where(new, (shape.astype(np.uint64) + np.uint64(1)) * textnum._MULTIPLIERS[place % textnum._PLACES], np.uint64(0))
    return textnum.mixed(np.add.reduceat(value, firsts))


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed n-grams of each row, and the offsets of the rows in them."""
    w = textnum.words(column)
    repeats = np.zeros(len(w.hashes), bool)
    repeats[1:] = (w.hashes[1:] == w.hashes[:-1]) & (w.doc[1:] == w.doc[:-1])
    shapes = _shape_hashes(w) + repeats.astype(np.uint64)
    parts = [(w.hashes, w.doc)] + [textnum.ngrams(w, n, shapes) for n in (1, 2, 3)]
    keys = [(d.astype(np.uint64) << np.uint64(BITS)) | ((h + np.uint64(k)) * textnum._MIX >> np.uint64(64 - BITS)) for k, (h, d) in enumerate(parts)]
    keys = np.unique(np.concatenate(keys))
    offsets = np.searchsorted(keys, np.arange(len(column) + 1).astype(np.uint64) << np.uint64(BITS))
    return (keys & np.uint64((1 << BITS) - 1)).astype(np.int32), offsets


def fit(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0, cost: float = 1.0, epochs: int = 12, min_rows: int = 3, seed: int = 7) -> Model:
    """Fit on sparse indicator rows; ``y``: 1 or 0. Every fourth row sets the logistic scale.

    With no rows, or rows of one class, every document gets the share of class 1.
    """
    rng = np.random.default_rng(seed)
    width = 1 << BITS
    y = np.asarray(y)
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(width, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    order = rng.permutation(len(rows))
    train, held = order[len(rows) // 4 :], order[: len(rows) // 4]
    p, q = np.full(width, alpha), np.full(width, alpha)
    for i in train:
        (p if y[i] else q)[rows[i]] += 1
    seen = p + q - 2 * alpha
    ratio = np.where(seen >= min_rows, np.log((p / p.sum()) / (q / q.sum())), 0.0)
    sign = np.where(y == 1, 1.0, -1.0)
    limit = {1: cost * len(train) / (2 * max(1, (y[train] == 1).sum())), 0: cost * len(train) / (2 * max(1, (y[train] == 0).sum()))}
    values = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    square = np.array([v @ v + 1.0 for v in values])
    w, bias, dual = np.zeros(width), 0.0, np.zeros(len(rows))
    for _ in range(epochs):
        for i in rng.permutation(train):
            gradient = sign[i] * (values[i] @ w[rows[i]] + bias) - 1.0
            new = min(max(dual[i] - gradient / square[i], 0.0), limit[int(y[i])])
            if new != dual[i]:
                step = (new - dual[i]) * sign[i]
                w[rows[i]] += step * values[i]  # a row's n-grams are distinct
                bias += step
                dual[i] = new
    margin = np.array([values[i] @ w[rows[i]] + bias for i in held])
    slope, shift = _logistic(margin, y[held])
    return Model((w * ratio).astype(np.float32), float(bias), slope, shift)


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(y = 1) by Newton's method, with targets drawn in from 0 and 1."""
    a, b = 1.0, 0.0
    if len(set(y.tolist())) < 2:
        return a, b
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = p - target, p * (1 - p) + 1e-9
        ga, gb = g @ margin + 1e-3 * (a - 1), g.sum()
        haa, hab, hbb = h @ (margin * margin) + 1e-3, h @ margin, h.sum()
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
        if abs(da) + abs(db) < 1e-9:
            break
    return float(max(a, 1e-3)), float(b)


def scores(model: Model, column: pa.Array) -> np.ndarray:
    out = np.empty(len(column))
    for first, part in textnum.pieces(column):
        ids, at = features(part)
        size = np.diff(at)
        total = np.concatenate([[0.0], np.cumsum(model.weights[ids], dtype=np.float64)])
        margin = (total[at[1:]] - total[at[:-1]]) / np.sqrt(np.maximum(size, 1)) + model.bias
        out[first : first + len(part)] = 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -30, 30)))
    return out


def fold(doc_id: Column) -> Column:
    """The part of four that a row belongs to; one without doc_id is in part 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 8000, held_out: int = 2) -> Model:
    """Fit on labelled rows outside the held-out fold, on at most about ``max_rows`` of them.

    The rows are those with the lowest hashes of their ids, so the same ones each time,
    and their labels are a table of that size, which is broadcast. The rows' n-grams
    meet in the driver, which the bound makes safe. Conflicting labels of an id count
    as the lower one; null labels and ids are left out.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != held_out))
    n = usable.count()
    if n > max_rows:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * max_rows / n))
    picked = usable.groupBy("doc_id").agg((F.min(label) > 0).cast("int").alias("y"))
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("y", "text")

    def rows(batches):
        for batch in batches:
            for first, part in textnum.pieces(batch.column("text")):
                ids, at = features(part)
                packed = [ids[at[i] : at[i + 1]].tobytes() for i in range(len(part))]
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(first, len(part)), pa.array(packed, pa.binary())], ["y", "ids"])

    got = sample.mapInArrow(rows, "y int, ids binary").toArrow().combine_chunks()
    found = sorted(zip(got["ids"].to_pylist(), got["y"].to_pylist(), strict=True))  # in one order wherever the rows were read
    return fit([np.frombuffer(x, np.int32) for x, _ in found], np.array([y for _, y in found], int))


def classify(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Add ``score`` (0 to 1, higher: class 1 likelier) and ``predicted`` to every row.

    Whole texts are scored; null and empty ones have no n-grams and get the model's
    base score. Equal texts get equal scores; columns named score or predicted are replaced.
    """

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(scores(model, column))

    docs = docs.drop("score", "predicted").withColumn("score", score(F.col(text)))
    return docs.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model).select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", "predicted")
