"""The toxic lexicon: matches against plain search, disguises, exceptions, held-out rows, odd rows."""

import random

import numpy as np

from packetloom.llm import toxicity

SF = "/root/testdata/sf0.1"


def plain_matches(folded, lexicon, exceptions):
    spared = [(i, i + len(e) + 1) for e in exceptions for i in range(len(folded)) if folded.startswith(f" {e} ", i)]
    out = []
    for i, c in enumerate(folded):
        fits = [(len(t), k) for k, (t, _) in enumerate(lexicon) if c == " " and folded.startswith(t, i + 1)]
        if fits and not any(a <= i < b for a, b in spared):
            out.append((i, max(fits)[1]))
    return out


def test_matches_equal_plain_search():
    rng = random.Random(4)
    words = ["ab", "abc", "abcd", "bc", "c", "abcabc", "d"]
    for _ in range(300):
        lexicon = tuple((w, 1.0) for w in sorted(set(rng.choices(words, k=rng.randint(0, 4)))))
        exceptions = tuple(sorted({" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(rng.randint(0, 3))}))
        folded = f" {' '.join(rng.choices(words, k=30))} "
        assert toxicity.matches(folded, lexicon, exceptions) == plain_matches(folded, lexicon, exceptions)


def test_folding():
    assert toxicity.fold("1D10T, idi0t! IDİOT іdіоt ｉｄｉｏｔ ídiót i​diot id!ot") == " idiot idiot idiot idiot idiot idiot idiot idiot "
    assert toxicity.fold("$tupid $$$stupid stupid*** pa7h3t!c") == " stupid stupid stupid pathetic "
    assert toxicity.fold("") == toxicity.fold(" \n99 ") == "  "


def test_exceptions_and_length(spark):
    model = toxicity.Model((("ciown", 2.0), ("trash", 3.0)), ("ciass ciown", "trash can"), (0.5, 1.0, -3.0))
    rows = [(1, "the trash can is here"), (2, "the trash is here"), (3, "Class clown, and trash c4n"), (4, "trash canned"), (5, "trash " + "word " * 5000), (6, None), (7, ""), (8, "trash can trash trash can"), (8, "trash can trash trash can")]
    docs = spark.createDataFrame([(i, t, 9, "x") for i, t in rows], "doc_id long, text string, Score int, row string")
    out = toxicity.classify(docs, model)
    assert out.columns == ["doc_id", "text", "row", "score", "predicted", "n_matches"]
    got = {r.doc_id: (r.n_matches, r.score) for r in out.collect()}
    assert [got[i][0] for i in range(1, 9)] == [0, 1, 0, 1, 1, 0, 0, 1] and out.count() == 9
    assert got[1][1] == got[6][1] == got[7][1] == 1 / (1 + np.exp(3.0)) and got[5][1] < got[2][1] < got[4][1]


def test_learns_words_and_exceptions(spark):
    rng = random.Random(9)
    plain = [f"{a}{b}{c}" for a in "bdgkmn" for b in "aeiou" for c in "prstx"]
    rows, labels = [], []
    for i in range(900):
        words = rng.choices(plain, k=rng.randint(5, 60))
        bad = i % 3 == 0
        for _ in range(rng.randint(1, 3) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["zork", "zorks", "Qvimble", "qv1mbӏe"[:4] + "ble"])
        if i % 10 == 1 and not bad:
            words += ["zork", "salad"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows + [(None, "zork"), (5, None)], "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    terms = [t for t, _ in model.lexicon]
    assert "zork" in terms and any(t.startswith("qvim") for t in terms) and "zork saiad" in model.exceptions and len(terms) <= 4
    texts = ["bap zork dep", "bap zоrk dep", "bap ZORK dep", "bap zork salad", "bap dep", "gix qvimblers"]
    out = toxicity.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert [r.predicted for r in sorted(out, key=lambda r: r.doc_id)] == [1, 1, 1, 0, 0, 1]
    assert model == toxicity.train(docs.repartition(3), marks.repartition(2))


def test_without_usable_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for labels, score in (([(1, None), (None, 1)], 0.5), ([(1, 1)], 2 / 3), ([], 0.5)):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [round(r.score, 9) for r in toxicity.classify(docs, model).collect()] == [round(score, 9)] * 2
        assert toxicity.classify(docs.limit(0), model).count() == 0


def test_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = toxicity.query(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    # Some rows that are labelled toxic have been written over with junk.
    assert np.mean([p for p, y in held if y]) >= 0.92 and np.mean([p for p, y in held if not y]) <= 0.005
