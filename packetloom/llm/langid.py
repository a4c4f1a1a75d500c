"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on windows of labelled
texts. It labels every byte of every text; the probabilities of a document's positions
are pooled as the mean of their logarithms. A text is cut into windows of a fixed
number of bytes, which run side by side through the matrix products; a window's state
begins at zero, as in training. Rows that no window was drawn from then tell how far the
pooled mean of a text of some length can be trusted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textnum
from .nbsvm import fold
from .scratch import stage

HIDDEN, WINDOW = 8, 96
#: Windows that are drawn from each text to learn from.
DRAWN = 16


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    params: dict[str, np.ndarray]
    scale: float = 1.0  # a document's logits are its mean log probabilities times scale * bytes ** power
    power: float = 0.5


def _new(classes: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    h, out = HIDDEN, {}
    for d in ("f", "b"):  # forward and backward
        out[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * h))  # a byte's input to update, reset and candidate
        out[f"u{d}"] = rng.normal(0, 0.35, (h, 3 * h))
        out[f"c{d}"] = np.tile(np.repeat([0.0, 0.5, 0.0], h), 1)
    out["v"] = rng.normal(0, 0.3, (2 * h, classes))
    out["o"] = np.zeros(classes)
    return {k: v.astype(np.float32) for k, v in out.items()}


def _run(p: dict, d: str, codes: np.ndarray) -> tuple[np.ndarray, list]:
    """States after each step, (steps, rows, HIDDEN), and what gradients need of it. ``codes``: (steps, rows) bytes in running order.

    Gates are logistic functions, computed as tanh of half the input.
    """
    h = HIDDEN
    x, u = (p[f"x{d}"] + p[f"c{d}"]).astype(np.float32), p[f"u{d}"].copy()
    x[:, : 2 * h] *= 0.5
    u[:, : 2 * h] *= 0.5
    steps, rows = codes.shape
    state = np.zeros((rows, h), np.float32)
    states, kept = np.empty((steps, rows, h), np.float32), []
    for t in range(steps):
        a, b = x[codes[t]], state @ u
        gates = np.tanh(a[:, : 2 * h] + b[:, : 2 * h])
        gates *= 0.5
        gates += 0.5
        z, r = gates[:, :h], gates[:, h:]
        own = b[:, 2 * h :]
        c = np.tanh(a[:, 2 * h :] + r * own)
        kept.append((state, z, r, own, c))
        state = c + z * (state - c)
        states[t] = state
    return states, kept


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def _states(p: dict, d: str, codes: np.ndarray, real: np.ndarray | None = None) -> np.ndarray:
    """The states of :func:`_run` as (steps, HIDDEN, rows), for labelling: rows lie side by side and no array is made anew."""
    h, (steps, rows) = HIDDEN, codes.shape
    x, u = (p[f"x{d}"] + p[f"c{d}"]).T.copy(), p[f"u{d}"].T.copy()
    x[: 2 * h] *= 0.5
    u[: 2 * h] *= 0.5
    states, state = np.empty((steps, h, rows), np.float32), np.zeros((h, rows), np.float32)
    given, own, gates, c, kept = (np.empty((k * h, rows), np.float32) for k in (3, 3, 2, 1, 1))
    full = np.ones(steps, bool) if real is None else real.all(axis=1)
    for t in range(steps):
        np.take(x, codes[t], axis=1, out=given)
        np.matmul(u, state, out=own)
        np.add(given[: 2 * h], own[: 2 * h], out=gates)
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        np.multiply(gates[h:], own[2 * h :], out=c)
        c += given[2 * h :]
        np.tanh(c, out=c)
        np.subtract(state, c, out=kept)
        kept *= gates[:h]
        np.add(c, kept, out=states[t])
        if not full[t]:
            states[t] *= real[t]
        state = states[t]
    return states


def position_log_probabilities(p: dict, codes: np.ndarray, real: np.ndarray) -> np.ndarray:
    """(steps, classes, rows) for windows of bytes, codes (steps, rows), of which ``real`` are no padding."""
    forward = _states(p, "f", codes)
    backward = _states(p, "b", codes[::-1], real[::-1].astype(np.float32))[::-1]
    h = HIDDEN
    x = np.matmul(p["v"][:h].T, forward) + np.matmul(p["v"][h:].T, backward) + p["o"][:, None]
    x -= x.max(axis=1, keepdims=True)
    x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
    return x


def gradients(p: dict, codes: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the positions in ``mask`` (steps, rows), and its gradients, back through time."""
    h, steps = HIDDEN, len(codes)
    runs = {"f": (codes, *_run(p, "f", codes)), "b": (codes[::-1], *_run(p, "b", codes[::-1]))}
    forward, backward = runs["f"][1], runs["b"][1][::-1]
    log_p = _log_softmax(forward @ p["v"][:h] + backward @ p["v"][h:] + p["o"])
    n = max(1.0, float(mask.sum()))
    rows = np.arange(codes.shape[1])
    loss = -float((log_p[:, rows, y] * mask).sum()) / n
    d = np.exp(log_p)
    d[:, rows, y] -= 1
    d *= (mask / n)[:, :, None]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    flat = d.reshape(-1, d.shape[2])
    g["o"] = flat.sum(axis=0)
    g["v"][:h] = forward.reshape(-1, h).T @ flat
    g["v"][h:] = backward.reshape(-1, h).T @ flat
    for name, half in (("f", p["v"][:h]), ("b", p["v"][h:])):
        order, _, kept = runs[name]
        into = d @ half.T
        into = into if name == "f" else into[::-1]
        u, back = p[f"u{name}"], np.zeros((codes.shape[1], h), np.float32)
        spread = np.zeros((steps * codes.shape[1], 3 * h), np.float32)
        for t in range(steps - 1, -1, -1):
            state, z, r, own, c = kept[t]
            back = back + into[t]
            dc = back * (1 - z) * (1 - c * c)
            dz = back * (state - c) * z * (1 - z)
            dr = dc * own * r * (1 - r)
            a = np.concatenate([dz, dr, dc], axis=1)
            spread[t * len(a) : (t + 1) * len(a)] = a
            inner = np.concatenate([dz, dr, dc * r], axis=1)
            g[f"u{name}"] += state.T @ inner
            back = back * z + inner @ u.T
        g[f"c{name}"] = spread.sum(axis=0)
        flat_codes = np.ascontiguousarray(order).reshape(-1)
        for k in range(3 * h):
            g[f"x{name}"][:, k] = np.bincount(flat_codes, spread[:, k], 256)
    return loss, g


def fit(texts: list[bytes], labels: list[str], steps: int = 260, rows: int = 128, rate: float = 0.02, seed: int = 3) -> Model:
    """Adam on random windows, as many of each language.

    A language whose texts are all empty isn't learned; without texts the model knows no language.
    """
    languages = tuple(sorted({x for t, x in zip(texts, labels, strict=True) if t}))
    rng = np.random.default_rng(seed)
    p = _new(max(1, len(languages)), rng)
    by = [[t for t, x in zip(texts, labels, strict=True) if x == name and t] for name in languages]
    if len(languages) < 2:
        return Model(languages, p)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        y = rng.integers(0, len(languages), rows)
        codes, mask = np.full((WINDOW, rows), 32, np.uint8), np.zeros((WINDOW, rows), np.float32)
        for i, k in enumerate(y):
            t = by[k][rng.integers(len(by[k]))]
            at = int(rng.integers(0, len(t) - WINDOW // 2)) if len(t) > WINDOW else 0
            part = np.frombuffer(t[at : at + WINDOW], np.uint8)
            codes[: len(part), i] = part
            mask[: len(part), i] = 1
        _, g = gradients(p, codes, mask, y)
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        now = rate * min(1.0, step / 20) * (1 if step < steps * 0.7 else 0.25)
        for k, x in g.items():
            x = x * min(1.0, 1.0 / max(norm, 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * x
            s[k] = 0.99 * s[k] + 0.01 * x * x
            p[k] = (p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return Model(languages, p)


def means(model: Model, column: pa.Array, most: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """(rows, classes): the mean of the log probabilities of all positions of each row, and the rows' bytes."""
    out, sizes = np.zeros((len(column), max(1, len(model.languages)))), np.zeros(len(column), np.int64)
    for first, part in textnum.pieces(column, most):
        data, at = textnum.utf8(part)
        size = np.diff(at)
        windows = -(-size // WINDOW)
        doc = np.repeat(np.arange(len(part)), windows)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
        begin = at[:-1][doc] + nth * WINDOW
        count = np.minimum(WINDOW, at[1:][doc] - begin)
        total = np.zeros((len(part), max(1, len(model.languages))))
        order = np.argsort(-count, kind="stable")
        for a in range(0, len(order), 2048):
            w = order[a : a + 2048]
            steps = int(count[w].max())
            spots = begin[w][None, :] + np.arange(steps)[:, None]
            real = np.arange(steps)[:, None] < count[w][None, :]
            codes = np.where(real, data[np.minimum(spots, len(data) - 1)], np.uint8(32))
            log_p = position_log_probabilities(model.params, codes, real)
            log_p *= real[:, None, :]
            np.add.at(total, doc[w], log_p.sum(axis=0, dtype=np.float64).T)
        out[first : first + len(part)] = total / np.maximum(size, 1)[:, None]
        sizes[first : first + len(part)] = size
    return out, sizes


def _softmax(mean: np.ndarray, size: np.ndarray, scale: float, power: float) -> np.ndarray:
    logits = mean * (scale * np.maximum(size, 1) ** power)[:, None]
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def pooled(model: Model, column: pa.Array) -> np.ndarray:
    """(rows, classes): probabilities of each row's language from all its positions."""
    # rounded, as matrix products of other sizes differ in their last bits
    return np.round(_softmax(*means(model, column), model.scale, model.power), 5)


def calibrated(model: Model, mean: np.ndarray, size: np.ndarray, y: np.ndarray) -> Model:
    """``model`` with the scale and power that give rows of languages ``y`` (numbers) the least loss.

    Neighbouring positions see the same letters, so a text's evidence grows by less than
    its length. A small share of each probability is spread over all languages, as an
    error among few rows can't be ruled out.
    """
    if not len(y):
        return model
    spread = 1.0 / (len(y) + 2)
    best = (np.inf, model.scale, model.power)
    for power in (0.0, 0.25, 0.5, 0.75, 1.0):
        for scale in 10.0 ** np.linspace(-2, 3, 51):
            p = _softmax(mean, size, scale, power)[np.arange(len(y)), y]
            best = min(best, (-float(np.log((1 - spread) * p + spread / mean.shape[1]).mean()), float(scale), power))
    return replace(model, scale=best[1], power=best[2])


def train(docs: DataFrame, max_rows: int = 3000, held_out: int = 2, text: str = "text", label: str = "lang") -> Model:
    """Fit on at most about ``max_rows`` labelled rows outside the held-out fold, as many of each language.

    Of a language with more rows than its share, those with the lowest hashes of their
    ids are taken; a rarer one keeps all its rows. Of each row ``DRAWN`` windows at
    random places of the whole text are learned from. Every fourth row is not, and sets
    how probabilities are pooled; one row of each language is always learned from. Null
    labels and null or empty texts are left out, and so are languages that have no others.
    """
    usable = docs.select("doc_id", F.col(text).alias("text"), F.col(label).alias("y")).where(F.col("y").isNotNull() & (F.col("text") != "") & (fold(F.col("doc_id")) != held_out))
    found = {r.y: r.n for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not found:
        return fit([], [])
    share = max_rows / len(found)
    limits = F.create_map(*[F.lit(x) for y, n in sorted(found.items()) for x in (y, int(1_000_003 * min(1.0, share / n)))])
    picked = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.element_at(limits, F.col("y")))
    nth = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id", F.lit("pool")), "text"))  # the sample's rows are few
    sample = stage(picked.select("text", "y", ((F.pmod(F.xxhash64("doc_id", F.lit("pool")), F.lit(4)) == 0) & (nth > 1)).alias("pool")), "lang-sample")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = []
            for t in batch.column("text").to_pylist():
                body = t.encode()
                rng = np.random.default_rng(zlib.crc32(body))
                at = rng.integers(0, max(1, len(body) - WINDOW // 2), DRAWN if len(body) > WINDOW else 1)
                windows.append([body[k : k + WINDOW] for k in at.tolist()] if len(body) > WINDOW else [body])
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(windows, pa.list_(pa.binary()))], ["y", "windows"])

    got = sample.where("NOT pool").select("y", "text").mapInArrow(draw, "y string, windows array<binary>").toArrow()
    rows = sorted((y, w) for y, all_ in zip(got["y"].to_pylist(), got["windows"].to_pylist(), strict=True) for w in all_)
    model = fit([w for _, w in rows], [y for y, _ in rows])
    if len(model.languages) < 2:
        return model

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mean, size = means(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(mean), pa.list_(pa.float64())), pa.array(size)], ["y", "mean", "size"])

    known = sample.where(F.col("pool")).select("y", "text")
    got = known.mapInArrow(measure, "y string, mean array<double>, size long").toArrow().sort_by([("y", "ascending"), ("size", "ascending")])
    at = {name: i for i, name in enumerate(model.languages)}
    mean = np.array(got["mean"].to_pylist(), float).reshape(-1, len(model.languages))
    return calibrated(model, mean, got["size"].to_numpy(), np.array([at[y] for y in got["y"].to_pylist()], int))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) to every row.

    ``und`` with score 0 where the text is null or has no letter, or no language was
    learned. Whole texts are labelled; equal texts get equal results; columns named
    lang_pred or score are replaced, all others stay, whatever their names.
    """
    names = np.array([*model.languages, "und"], object)

    @F.arrow_udf("struct<lang:string,p:double>")
    def label(column: pa.Array) -> pa.Array:
        p = pooled(model, column)
        best = p.argmax(axis=1)
        return pa.StructArray.from_arrays([pa.array(names[best].tolist(), pa.string()), pa.array(p[np.arange(len(p)), best])], ["lang", "p"])

    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {"lang_pred", "score"}]
    body = F.col(f"`{text}`")
    known = F.coalesce(body.rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(model.languages))
    found = docs.select(F.struct(*rest).alias("row"), known.alias("known"), label(body).alias("label"))
    return found.select("row.*", F.when(F.col("known"), F.col("label.lang")).otherwise("und").alias("lang_pred"), F.when(F.col("known"), F.col("label.p")).otherwise(0.0).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")
