"""The quality classifier and language identification: held-out accuracy, gradients, odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from packetloom.llm import langid, nbsvm

SF = "/root/testdata/sf0.01"


def test_classifier_on_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = nbsvm.query(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_classifier_reads_text_and_nothing_else(spark):
    model = nbsvm.fit([np.array([1, 2], np.int32), np.array([3], np.int32)] * 8, np.array([1, 0] * 8))
    rows = [(1, "same text here", 5.0, 9), (2, "same text here", None, None), (3, None, 1.0, 1), (4, "", 1.0, 1), (4, "w " * 50000, 1.0, 1)]
    out = nbsvm.classify(spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int"), model).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r.score)
    assert by[1] == by[2] and by[3][0] in by[4] and len(out) == 5 and out[0].asDict().keys() == {"doc_id", "text", "score", "predicted"}


def test_classifier_without_usable_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    out = nbsvm.classify(docs, nbsvm.train(docs, labels)).collect()
    assert [r.score for r in out] == [0.5, 0.5]
    assert nbsvm.classify(docs.limit(0), nbsvm.train(docs, labels)).count() == 0


def test_dual_coordinate_descent_separates(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    rows = [np.unique(np.concatenate([rng.integers(100, 300, 12), rng.integers(0, 10, 4) + (10 if k else 30)])).astype(np.int32) for k in y]
    model = nbsvm.fit(rows, y)
    margin = np.array([model.weights[r].sum() / np.sqrt(len(r)) + model.bias for r in rows])
    assert np.mean((margin > 0) == (y == 1)) > 0.97


def test_features_are_indicators_of_words_and_shapes():
    ids, at = nbsvm.features(pa.array(["a b", "a b a b", None, "A1"]))
    assert set(ids[at[0] : at[1]]) <= set(ids[at[1] : at[2]]) and at[2] == at[3] and at[4] > at[3]
    assert all(len(set(ids[a:b])) == b - a for a, b in zip(at, at[1:], strict=False))


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in langid._new(3, rng).items()}
    codes = rng.integers(97, 101, (7, 5)).astype(np.uint8)
    mask = (rng.random((7, 5)) < 0.8).astype(float)
    y = rng.integers(0, 3, 5)
    p32 = {k: v.astype(np.float32) for k, v in p.items()}
    _, g = langid.gradients(p32, codes, mask, y)
    for name in p32:
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        eps = 1e-2
        hi, lo = ({k: v.copy() for k, v in p32.items()} for _ in range(2))
        hi[name][at] += eps
        lo[name][at] -= eps
        slope = (langid.gradients(hi, codes, mask, y)[0] - langid.gradients(lo, codes, mask, y)[0]) / (2 * eps)
        assert slope == pytest.approx(g[name][at], rel=0.05, abs=2e-4), name


def test_language_on_held_out_rows(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = langid.query(spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert np.mean([langs[r.doc_id] == r.lang_pred for r in held]) >= 0.97
    assert len(rows) == len(langs) and all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(spark):
    texts = ["the rather then " * 30, "été déjà où " * 30] * 30
    model = langid.fit([t.encode() for t in texts], ["en", "fr"] * 30, steps=60)
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the then rather the"), (4, "the then rather the"), (5, "où été déjà " * 20000)]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    by = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert [by[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and by[4][0] == "en" and by[5][0] == "fr" and len(out) == 6
    assert langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), langid.fit([], [])).first().lang_pred == "und"


def test_windows_are_labelled_alike_wherever_they_run():
    model = langid.fit([b"aaa bbb " * 40, b"ccc ddd " * 40] * 4, ["x", "y"] * 4, steps=10)
    texts = ["aaa ddd " * 100, "b", None, "ccc " * 7]
    whole = langid.pooled(model, pa.array(texts))
    alone = np.concatenate([langid.pooled(model, pa.array([t])) for t in texts if t])
    assert np.allclose(whole[[0, 1, 3]], alone, atol=2e-5)


def test_a_rare_language_is_learned_beside_common_ones(spark):
    """The sample is drawn by language, so a language with one row in a thousand is among the learned ones."""
    rows = [(i, ("the then rather other " if i % 2 else "où été déjà près ") * 12, "en" if i % 2 else "fr") for i in range(4000)]
    rows += [(10_000 + i, "żółw gęś źdźbło łąka " * 12, "pl") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, max_rows=300)
    assert model.languages == ("en", "fr", "pl")
    out = {r.doc_id: r.lang_pred for r in langid.identify(docs.where("doc_id < 3 OR doc_id >= 10000"), model).collect()}
    assert out[0] == "fr" and out[1] == "en" and {out[10_000 + i] for i in range(4)} == {"pl"}


def test_language_windows_come_from_whole_texts(spark):
    """A long text whose first part says nothing is still learned from."""
    rows = [(i, "0 " * 4000 + ("the then rather other " if i % 2 else "où été déjà près ") * 400, "en" if i % 2 else "fr") for i in range(60)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    out = langid.identify(spark.createDataFrame([(1, "the other then"), (2, "déjà été près où")], "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in out] == ["en", "fr"]


def test_language_of_empty_tables_and_clashing_columns(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a b", None, "x", 1.0), (1, "a b", None, "x", 1.0)], "doc_id long, text string, lang string, lang_pred string, score double")
    model = langid.train(docs)
    assert model.languages == () and langid.train(docs.limit(0)).languages == ()
    out = langid.identify(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and {r.lang_pred for r in out.collect()} == {"und"}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for module in (langid, nbsvm):
        held = {r.doc_id: r.held_out for r in module.query(spark, str(tmp_path)).collect()}
        assert held[None] is False and held[1] in (True, False)


def test_pooling_is_calibrated():
    rng = np.random.default_rng(0)
    size = rng.integers(20, 4000, 3000)
    truth = rng.integers(0, 3, 3000)
    mean = rng.normal(0, 1, (3000, 3)) / np.sqrt(size)[:, None]
    mean[np.arange(3000), truth] += 1.0 / np.sqrt(size)
    model = langid.calibrated(langid.Model(("a", "b", "c"), {}), mean, size, truth)
    p = langid._softmax(mean, size, model.scale, model.power)
    sure = p.max(axis=1)
    assert model.power == 0.5 and abs(sure.mean() - (p.argmax(axis=1) == truth).mean()) < 0.03


def test_classifier_against_brute_force():
    """The dual's weights come near the minimum of the primal hinge loss over the same scaled indicators."""
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 200)
    rows = [np.unique(rng.integers(0, 30, 8) + (0 if k else 15)).astype(np.int32) for k in y]
    model = nbsvm.fit(rows, y, min_rows=0, epochs=200, seed=7)
    order = np.random.default_rng(7).permutation(len(rows))
    train = order[len(rows) // 4 :]
    x = np.zeros((len(train), 60))
    for a, i in enumerate(train):
        x[a, rows[i]] = 1 / np.sqrt(len(rows[i]))
    sign = np.where(y[train] == 1, 1.0, -1.0)
    cost = np.where(y[train] == 1, len(train) / (2 * (y[train] == 1).sum()), len(train) / (2 * (y[train] == 0).sum()))
    ratio = model_ratio(rows, y, train)
    scaled = x * ratio

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - sign * (scaled @ w + b))).sum()

    w, b = np.zeros(60), 0.0
    best = loss(w, b)
    for step in range(20_000):  # plain subgradient descent
        hit = sign * (scaled @ w + b) < 1
        gw, gb = w - ((cost * sign * hit)[:, None] * scaled).sum(axis=0), b - (cost * sign * hit).sum()
        w, b = w - 0.05 / (1 + step / 50) * gw, b - 0.05 / (1 + step / 50) * gb
        best = min(best, loss(w, b))
    own = model.weights[:60] / np.where(ratio == 0, 1, ratio)
    assert loss(own, model.bias) <= best * 1.02 + 1e-6


def model_ratio(rows, y, train):
    """Log-count ratios over the hashed width, as in the model: smoothing counts for all of it."""
    width = 1 << nbsvm.BITS
    p, q = np.ones(width), np.ones(width)
    for i in train:
        for k in rows[i]:
            (p if y[i] else q)[k] += 1
    return np.log((p / p.sum()) / (q / q.sum()))[:60]


def test_a_score_at_the_threshold_is_accepted(spark):
    shift = float(np.log(0.75 / 0.25))
    model = nbsvm.Model(np.zeros(1 << nbsvm.BITS, np.float32), 0.0, 0.0, shift)
    out = nbsvm.classify(spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string"), model, threshold=1 / (1 + np.exp(-shift))).collect()
    assert [r.predicted for r in out] == [1, 1]


def test_labelling_runs_the_network_that_is_trained():
    """The states of labelling are those of training; padding before a text's end leaves the backward ones at zero."""
    rng = np.random.default_rng(2)
    p = langid._new(3, rng)
    codes = rng.integers(0, 256, (20, 7)).astype(np.uint8)
    for way in "fb":
        assert np.allclose(langid._states(p, way, codes), langid._run(p, way, codes)[0].transpose(0, 2, 1), atol=1e-5)
    real = np.arange(20)[:, None] < rng.integers(1, 21, 7)[None, :]
    whole = langid.position_log_probabilities(p, codes, real)
    for i in range(7):
        n = int(real[:, i].sum())
        alone = langid.position_log_probabilities(p, codes[:n, i : i + 1], np.ones((n, 1), bool))
        assert np.allclose(whole[:n, :, i], alone[:, :, 0], atol=1e-5)


def test_languages_of_empty_or_few_texts_do_not_spoil_the_others(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    bad = [(10**6 + i, "", "xx") for i in range(100)] + [(2 * 10**6, None, "yy"), (3 * 10**6, "żółw gęś źdźbło łąka " * 30, "pl"), (4 * 10**6, "这是一句话", "zh"), (4 * 10**6 + 4, "那是另一句话", "zh")]
    all_ = docs.unionByName(spark.createDataFrame(bad, "doc_id long, text string, lang string"))
    model = langid.train(all_)
    learned = {r.lang for r in all_.where((langid.fold(all_.doc_id) != 2) & (all_.text != "") & all_.lang.isNotNull()).select("lang").distinct().collect()}
    assert set(model.languages) == learned and "xx" not in learned
    out = langid.identify(docs.where((langid.fold(docs.doc_id) == 2) & docs.text.rlike(r"\p{L}") & docs.lang.isNotNull()), model).collect()
    assert len(out) > 100 and np.mean([r.lang == r.lang_pred for r in out]) >= 0.99


@pytest.mark.parametrize("seed", range(4))
def test_a_language_of_one_row_is_learned(spark, seed):
    ids = [i for i in range(1000 * seed, 1000 * seed + 400) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, ("the then rather other " if i % 2 else "où été déjà près ") * 12, "en" if i % 2 else "fr") for i in ids[1:]] + [(ids[0], "żółw gęś źdźbło łąka " * 12, "pl")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=200)
    assert model.languages == ("en", "fr", "pl")
