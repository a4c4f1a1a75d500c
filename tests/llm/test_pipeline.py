"""The pipeline's stages, each on what the one before kept, held against the operators' brute-force properties."""

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from packetloom.llm import nbsvm
from test_jaccard import brute
from test_spans import private_of

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], SF).cache())
    for f in frames[1:-1]:
        assert f.columns == corpus_pipeline.COLUMNS
    rows = [f.collect() for f in frames[:-1]]
    model = nbsvm.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    accepted = {r.doc_id for r in nbsvm.classify(docs, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in rows[1]} == accepted
    groups = {i: c for i, c, _ in brute([(r.doc_id, r.text) for r in rows[1]])}
    assert sorted(r.doc_id for r in rows[2]) == sorted(set(groups.values()))
    assert {r.doc_id for r in rows[3]} == {r.doc_id for r in rows[2]} and not any(private_of(r.text) for r in rows[3])
    assert all(r.n_chars == len(r.text) for r in rows[3])
    before = {r.doc_id: r.text for r in rows[2]}
    assert all(before[r.doc_id] == r.text for r in rows[3] if not re.search("<(email|ip|card|phone|context)>", r.text))
    texts = {r.doc_id: r.text for r in rows[3]}
    assert all(texts[r.doc_id] == r.text for r in rows[4]) and 0.5 * len(texts) < len(rows[4]) < 1.7 * len(texts)
    packed = frames[-1].collect()
    whole = Counter(r.doc_id for r in packed if r.piece == 0)
    assert whole == Counter(r.doc_id for r in rows[4])
    ends = frames[-1].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= 2048 for r in ends)


ODD = [
    (1, "word " * 40_000, "en", "a", 200_000), (2, None, None, None, None), (None, "A clean line stands here. " * 9, "en", "a", 1), (3, "", "en", "a", 0), (3, "", "en", "a", 0),
    (4, "one two three four five six", "en", "b", 3), (5, "one two three four five six", "en", "b", 3), (6, "Mail bob.7@mail.example.com or +1 (017) 555-7713 now", "de", None, 9),
]


def odd(spark, rows=ODD):
    """Odd rows with a column that clashes with names used inside."""
    return spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, predicted int")


def test_stages_on_odd_rows(spark, tmp_path):
    spark.createDataFrame([(i, i % 2, 0) for i in (1, 4, 5, 6)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = dict(corpus_pipeline.STAGES)
    kept = names["quality classifier"](spark, odd(spark), str(tmp_path)).collect()
    assert {r.doc_id for r in kept} <= {r[0] for r in ODD}
    rows = names["near duplicates"](spark, odd(spark), str(tmp_path)).collect()
    assert Counter(r.doc_id for r in rows) == Counter([1, 2, None, 3, 4, 6])
    texts = {r.doc_id: r for r in names["personal data"](spark, odd(spark), str(tmp_path)).collect()}
    assert len(texts) == 7 and texts[2].text is None and texts[2].n_chars is None and texts[6].text == "Mail <email> or <phone> now" and texts[6].n_chars == 27 and texts[1].text == ODD[0][1]
    mixed = names["source mixing"](spark, odd(spark), str(tmp_path)).collect()
    assert {r.doc_id for r in mixed} <= {r[0] for r in ODD} and len([r for r in mixed if r.doc_id == 3]) % 2 == 0
    packed = names["packing"](spark, odd(spark), str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r[0] for r in ODD)


def test_stages_on_an_empty_table(spark):
    docs = odd(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and (name == "packing" or out.columns == corpus_pipeline.COLUMNS)
