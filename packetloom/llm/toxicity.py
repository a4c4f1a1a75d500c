"""A weighted lexicon of toxic word beginnings, matched by Aho-Corasick in folded texts.

Texts are folded first: case, accents, look-alike letters of other scripts, digits and marks
that stand for letters. The lexicon is learned from labelled rows: beginnings of words that
stand out in toxic rows, chosen by a sparse logistic model. Matches inside phrases of
exception don't count. What a text's matches weigh, and what they weigh for its length,
gives the score.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

# Letters that look like Latin ones, digits and marks that stand for letters.
# A folded text has i for l, as 1 and | stand for both.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ɑ": "a", "ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Phrases in which a word of abuse is none.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "idiot proof", "class clown", "clown fish", "clown car", "stupid simple", "pond scum", "soap scum", "sore loser")

LEAST, MOST = 3, 12  # letters of a lexicon entry
_BETWEEN = re.compile(r"(?<=[^\W_])[!|](?=[^\W_])")
_LEADING = re.compile(r"(?<![^\W_])[@$]{2,}")


class _Fold(dict):
    """Code points to their folded forms, worked out when first met."""

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", chr(code).lower()):
            c = LOOKALIKES.get(c, SUBSTITUTES.get(c, c))
            kind = unicodedata.category(c[0])
            if kind[0] == "L":
                out += c.replace("l", "i")
            elif kind not in ("Mn", "Cf"):
                out += " "
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """Words of folded letters with one space before, between and behind them."""
    if "!" in text or "|" in text:
        text = _BETWEEN.sub("i", text)
    if "$" in text or "@" in text:
        text = _LEADING.sub(" ", text)
    return f" {' '.join(text.translate(_FOLD).split())} "


@dataclass(frozen=True)
class Model:
    lexicon: tuple[tuple[str, float], ...]  # folded beginnings of words, weights over 0
    exceptions: tuple[str, ...]  # folded phrases of whole words
    weights: tuple[float, float, float]  # of log(1 + weight), of log(1 + weight for a hundred words), constant


@lru_cache(maxsize=4)
def _automaton(lexicon: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for k, (term, _) in enumerate(lexicon):
        out.add_word(" " + term, (k, len(term) + 1))
    for phrase in exceptions:
        # One phrase may be a beginning of another, never of a lexicon entry: it ends in a space.
        out.add_word(f" {phrase} ", (-1, len(phrase) + 2))
    if len(out):
        out.make_automaton()
    return out


def matches(folded: str, lexicon: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]) -> list[tuple[int, int]]:
    """Place and entry of each word that begins with a lexicon entry, the longest one, outside exceptions."""
    automaton = _automaton(lexicon, exceptions)
    if not len(automaton):
        return []
    longest: dict[int, int] = {}
    spared: list[tuple[int, int]] = []
    for end, (k, size) in automaton.iter(folded):
        start = end - size + 1
        if k < 0:
            spared.append((start, end))
        else:
            longest[start] = k  # a longer match of the same start comes later
    found, free, i = [], -1, 0
    spared.sort()
    for start in sorted(longest):
        while i < len(spared) and spared[i][0] <= start:
            free = max(free, spared[i][1])
            i += 1
        if start >= free:
            found.append((start, longest[start]))
    return found


def _weigh(text: str | None, model: Model) -> tuple[float, int, int]:
    """Weight of all matches, their number, and the number of words."""
    folded = fold(text or "")
    found = matches(folded, model.lexicon, model.exceptions)
    return sum(model.lexicon[k][1] for _, k in found), len(found), max(folded.count(" ") - 1, 0)


def _inputs(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.log1p(weight), np.log1p(100 * weight / (words + 20)), np.ones(len(weight))], 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def part(doc_id: Column) -> Column:
    """The part of three that a row belongs to; one without doc_id is in part 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0))


def _chosen(rows: list[list[int]], y: np.ndarray, n: int, penalty: float, steps: int = 400) -> np.ndarray:
    """Weights over 0 of a logistic model on indicators with an L1 penalty, by accelerated projected gradients."""
    x = np.zeros((len(rows), n + 1), np.float32)
    for i, found in enumerate(rows):
        x[i, found] = 1
    x[:, n] = 1
    w = np.zeros(n + 1)
    step = 4 * len(y) / max(1.0, float(np.linalg.norm(x, 2)) ** 2)
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        gradient = x.T @ (_sigmoid(x @ ahead) - y) / len(y)
        new = ahead - step * gradient
        new[:n] = np.maximum(new[:n] - step * penalty, 0)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (last - 1) / t * (new - w), new
    return w[:n]


def _calibrated(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, float, float]:
    """Slopes (not below 0) and constant of P(toxic), by projected Newton steps; ``share``: each row's weight."""
    w = np.array([1.0, 1.0, -3.0])
    ridge = np.array([0.02, 0.02, 1e-4])
    for _ in range(60):
        p = _sigmoid(x @ w)
        gradient = x.T @ (share * (p - y)) + ridge * w
        curve = x.T @ (x * (share * p * (1 - p))[:, None]) + np.diag(ridge)
        move = np.linalg.solve(curve, gradient)
        w = w - move * min(1.0, 2.0 / max(1e-9, np.abs(move).max()))
        w[:2] = np.maximum(w[:2], 0)
    return tuple(float(v) for v in w)


def _terms(sample: DataFrame, min_docs: int, min_evidence: float, max_candidates: int) -> list[tuple[str, float]]:
    """Beginnings of words that stand out in toxic rows, with the logs of the ratios of their frequencies.

    Counted in the tasks, summed by Spark; the ``max_candidates`` with the most evidence (log
    likelihood ratio) reach the driver. Where a longer beginning is in nearly as many toxic
    rows, the shorter one goes; where a shorter one weighs as much, the longer one goes.
    """

    def counted(batches):
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for term in {w[:k] for w in set(fold(text or "").split()) for k in range(LEAST, min(len(w), MOST) + 1)}:
                    counts.setdefault(term, [0, 0])[1 - y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([v[0] for v in counts.values()], pa.int64()), pa.array([v[1] for v in counts.values()], pa.int64())], ["term", "toxic", "clean"])

    totals = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    counts = sample.select("y", "text").mapInArrow(counted, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    both, a, b = F.col("toxic") + F.col("clean"), F.col("toxic"), F.col("clean")
    evidence = 2 * (a * F.log(a * (n1 + n0) / (both * n1)) + F.when(b > 0, b * F.log(b * (n1 + n0) / (both * n0))).otherwise(0.0))
    counts = counts.where((a >= min_docs) & (a * n0 > b * n1 * 4)).withColumn("evidence", evidence).where(F.col("evidence") >= min_evidence)
    found = counts.orderBy(F.desc("evidence"), "term").limit(max_candidates).collect()
    toxic = {r.term: (r.toxic, r.clean) for r in found}

    def weight(term: str) -> float:
        return np.log((toxic[term][0] + 1) / (n1 + 2)) - np.log((toxic[term][1] + 1) / (n0 + 2))

    whole = {t for t in toxic if not any(u != t and u.startswith(t) and toxic[u][0] >= 0.95 * toxic[t][0] for u in toxic)}
    kept: list[str] = []
    for term in sorted(whole, key=len):
        if not any(term.startswith(k) and weight(k) >= weight(term) - 0.5 for k in kept):
            kept.append(term)
    return [(t, float(weight(t))) for t in sorted(kept)]


def _exceptions(rows: list[tuple[int, list[str]]], min_docs: int = 3) -> list[str]:
    """Pairs of words with a match that several clean rows and hardly any toxic one have."""
    toxic: dict[str, int] = {}
    clean: dict[str, int] = {}
    for y, phrases in rows:
        for phrase in set(phrases):
            (toxic if y else clean)[phrase] = (toxic if y else clean).get(phrase, 0) + 1
    return sorted(p for p, n in clean.items() if n >= min_docs and toxic.get(p, 0) * 20 <= n)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 8000, held_out: int = 1, min_docs: int = 4, min_evidence: float = 16.0, max_candidates: int = 2000, penalty: float = 5e-4, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Learn from labelled rows outside the held-out part, from at most about ``max_rows`` of them.

    Half of them are toxic if there are so many; those with the lowest hashes of their ids
    are taken, so the same ones each time. Equal texts count once. An id with conflicting
    labels is toxic; null labels and ids are left out. Every fourth row is kept from the
    lexicon and sets the scale of the scores. With labels of one class or none the lexicon is
    empty and every document gets the share of toxic rows.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (part(F.col("doc_id")) != held_out)).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    totals = {r.y: r.n for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n = {k: totals.get(k, 0) for k in (0, 1)}
    half = max_rows // 2
    most = {k: max(half, max_rows - n[1 - k]) for k in n}
    picked = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.when(F.col("y") == 1, int(1_000_003 * min(1, most[1] / max(1, n[1])))).otherwise(int(1_000_003 * min(1, most[0] / max(1, n[0])))))
    folded = tuple(sorted({fold(e).strip() for e in exceptions} - {""}))
    if not (n[0] and n[1]):
        share = (n[1] + 1) / (n[0] + n[1] + 2)
        return Model((), folded, (0.0, 0.0, float(np.log(share / (1 - share)))))
    # Equal texts would count as evidence again and again; the rows are few, so their texts may be shuffled.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.max("y").alias("y"), F.count("*").alias("n"))
    sample = scratch.stage(rows.withColumn("rest", F.pmod(F.xxhash64("text"), F.lit(4)) == 0), "toxic")
    terms = _terms(sample.where(~F.col("rest")), min_docs, min_evidence, max_candidates)
    lexicon = tuple(terms)

    def found(batches):
        for batch in batches:
            ids, phrases = [], []
            for text in batch.column("text").to_pylist():
                words = fold(text)
                hits = matches(words, lexicon, folded)
                ids.append(sorted({k for _, k in hits}))
                near = []
                for at, _ in hits[:1000]:  # phrases of exception are a property of a lexicon, not a count
                    end = words.index(" ", at + 1)
                    before, after = words.rfind(" ", 0, at), words.find(" ", end + 1)
                    near += [words[before + 1 : end]] if before >= 0 and before + 1 < at else []
                    near += [words[at + 1 : after]] if after > end + 1 else []
                phrases.append(sorted(set(near)))
            columns = [batch.column("y"), batch.column("rest"), pa.array(ids, pa.list_(pa.int32())), pa.array(phrases, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["y", "rest", "ids", "phrases"])

    got = sample.select("y", "rest", "text").mapInArrow(found, "y int, rest boolean, ids array<int>, phrases array<string>").toArrow().to_pylist()
    got = sorted((r for r in got if not r["rest"]), key=lambda r: (r["y"], r["ids"], r["phrases"]))
    known = tuple(sorted({*folded, *_exceptions([(r["y"], r["phrases"]) for r in got])}))
    weights = _chosen([r["ids"] for r in got], np.array([r["y"] for r in got], float), len(lexicon), penalty)
    lexicon = tuple((t, w) for (t, w), chosen in zip(lexicon, weights, strict=True) if chosen > 1e-3)
    model = Model(lexicon, known, (0.0, 0.0, 0.0))

    def weighed(batches):
        for batch in batches:
            all_ = [_weigh(t, model) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("n"), pa.array([a for a, _, _ in all_], pa.float64()), pa.array([c for _, _, c in all_], pa.int64())], ["y", "n", "weight", "words"])

    got = sample.where("rest").select("y", "n", "text").mapInArrow(weighed, "y int, n long, weight double, words long").toArrow().sort_by([("y", "ascending"), ("weight", "ascending"), ("words", "ascending")])
    y = got["y"].to_numpy().astype(float)
    x = _inputs(got["weight"].to_numpy(), got["words"].to_numpy())
    # The sample has as many rows of each class; weights bring back their shares.
    ratio = {k: n[k] / min(n[k], most[k]) for k in n}
    share = np.where(y == 1, ratio[1], ratio[0])
    return Model(lexicon, known, _calibrated(x, y, share / share.mean()))


def classify(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Add ``score`` (0 to 1, higher: toxic likelier), ``predicted`` and ``n_matches`` to every row.

    Whole texts are scored; null and empty ones have no matches and get the model's base
    score. Equal texts get equal scores; columns of the new names are replaced, all others stay.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {"score", "predicted", "n_matches"}]

    @F.arrow_udf("struct<score: double, n_matches: bigint>")
    def scored(column: pa.Array) -> pa.Array:
        all_ = [_weigh(t, model) for t in column.to_pylist()]
        weight, words = np.array([a for a, _, _ in all_], float), np.array([c for _, _, c in all_], float)
        score = _sigmoid(_inputs(weight, words) @ np.array(model.weights))
        return pa.StructArray.from_arrays([pa.array(score, pa.float64()), pa.array([b for _, b, _ in all_], pa.int64())], ["score", "n_matches"])

    rows = docs.select(F.struct(*rest).alias("row"), scored(F.col(f"`{text}`")).alias("new"))
    return rows.select("row.*", "new.score", (F.col("new.score") >= threshold).cast("int").alias("predicted"), "new.n_matches")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model).select("doc_id", (part(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted")
