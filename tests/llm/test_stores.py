"""WARC archives, media chunks, mixing and quality rules: round trips and odd rows."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from packetloom.llm import langid, media, mixing, quality_rules, registry, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM read_parquet('{SF}/{t}')")
    df = registry.QUERIES[name](spark, SF)
    columns = ", ".join(sorted(df.columns))
    con.register("got_view", df.toPandas())
    con.execute(f"CREATE TABLE got AS SELECT {columns} FROM got_view")
    con.execute(f"CREATE TABLE want AS SELECT {columns} FROM ({registry.ORACLE_SQL[name]})")
    assert con.execute("SELECT (SELECT count(*) FROM (SELECT * FROM want EXCEPT ALL SELECT * FROM got)), (SELECT count(*) FROM (SELECT * FROM got EXCEPT ALL SELECT * FROM want))").fetchall() == [(0, 0)]


def test_media_round_trip(spark):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcde \n") for _ in range(20000))
    texts = [None, "", " ", "é" * 96, "x" * 192, "y" * 193, passage, passage, "head " * 300 + passage + "tail", passage[5000:], "z" * 300_000, "😀" * 5000]
    docs = spark.createDataFrame([(i // 2, t, 7, "d") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int, digests string")
    kept, shared = media.store(docs)
    rows = media.rebuild(kept, shared, media.DESCRIBED, media.described).collect()
    want = Counter()
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        want[i // 2, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), hashlib.sha256(media.wav(p)).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) for r in rows) == want
    assert shared.count() == shared.select("digest").distinct().count() > 0
    stored = kept.select(F.explode("own").alias("o")).where("o IS NOT NULL").count() + shared.count()
    assert stored < sum(len(media.chunks(media.wav(media.padded((t or "").encode())))) for t in texts)
    assert media.rebuild(*media.store(docs.limit(0)), media.DESCRIBED, media.described).count() == 0


def test_media_query_over_the_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = media.query(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        p = media.padded((texts[r.doc_id] or "").encode())
        assert (r.payload_sha256, r.payload_bytes) == (hashlib.sha256(p).hexdigest(), len(p))


def test_cuts_depend_on_content():
    rng = random.Random(3)
    data = bytes(rng.randrange(256) for _ in range(60000))
    a, b = media.chunks(data), media.chunks(b"0123456789" + data)
    assert b"".join(a) == data and len(set(a) & set(b)) >= len(a) - 2
    assert all(len(c) <= media.LONGEST for c in media.chunks(b"q" * 200_000))

    def slow(data):
        h, out = 0, []
        for i, x in enumerate(data):
            h = (2 * h + int(media._GEAR[x])) % 2**32
            out.append(h >> (32 - media.MASK_BITS) == 0)
        return [i + 1 for i, cut in enumerate(out) if cut]

    marks = {i for i in media.cuts(data)}
    assert marks - set(slow(data)) <= {len(data)}


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "ö" * 600
    rows = [(1, "u", big), (5, "u5", big), (3, "u", big), (4, "v", None), (6, None, ""), (7, "w\r\nX: y", "short"), (8, "w", "short"), (5, "again", big), (None, "n", big)]
    pages = spark.createDataFrame([(*r, "rt", 1) for r in rows], "page_id long, url string, html string, record_type string, payload int")
    path = warc.write_pages(pages, str(tmp_path / "w"))
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_pages(spark, path).collect())
    want = Counter()
    for i, _, t in rows:
        b = (t or "").encode()
        again = len(b) >= 1000 and i != 5
        want[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 5 if again else None] += 1
    assert got == want
    assert warc.read_pages(spark, warc.write_pages(pages.limit(0), str(tmp_path / "none"))).count() == 0


def test_warc_filters_reach_the_reader(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * 2000 * (i % 2)) for i in range(20)], "page_id long, url string, html string")
    path = warc.write_pages(pages, str(tmp_path / "w"))
    df = warc.read_warc(spark, path).where("record_type = 'response' AND target_uri IN ('http://h/3', 'http://h/19')")
    assert [r.target_uri for r in df.collect()] == ["http://h/19"] and df.first().payload == b"x" * 2000
    assert warc.read_warc(spark, path, payload=False).where("payload IS NOT NULL").count() == 0
    seen = []
    stream = warc._Skipping(__import__("io").BytesIO(warc.record({"WARC-Type": "response"}, b"abc") + warc.record({"WARC-Type": "revisit"}, b"")))
    assert [r["record_type"] for r in warc.read_records(stream, lambda r: seen.append(r["payload"]) or r["record_type"] == "revisit", True)] == ["revisit"] and not any(seen)


def test_mixing_rates(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 100 == 1, None).otherwise("small").alias("source"), F.lit("t").alias("text"), F.lit(9).alias("copy"))
    out = mixing.mix_sources(docs, {"big": 3.0, "small": 1.0})
    n = Counter(r.source for r in out.collect())
    assert abs(n["big"] - 4500) < 5 * math.sqrt(4500) and abs(n["small"] - 1500) < 5 * math.sqrt(1500) and None not in n
    rows = out.collect()
    assert [r.shuffle_key for r in rows] == sorted(r.shuffle_key for r in rows)
    even = Counter(r.source for r in mixing.mix_sources(docs).collect())
    assert set(even) == {"big", "small", None} and all(abs(v - 2000) < 300 for v in even.values())
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.mix_sources(docs, {}).count() == 0


def test_mixing_a_rare_source(spark):
    """One row among 200,000 in equal shares of two: some 100,000 copies, all different, from many tasks."""
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 77, "rare").otherwise("big").alias("source"), F.lit("t").alias("text"))
    out = mixing.mix_sources(docs).where("source = 'rare'")
    r = out.agg(F.count("*").alias("n"), F.countDistinct("copy").alias("copies"), F.min("copy").alias("least"), F.countDistinct("shuffle_key").alias("keys")).first()
    assert abs(r.n - 100_000) < 5 * math.sqrt(100_000) and r.n == r.copies == r.keys and r.least == 0


def test_mixing_odd_rows(spark):
    """Null ids and equal rows are drawn alike, long texts are carried whole, clashing columns go."""
    rows = [(None, "x" * 3_000_000, "a", 1), (5, "t", "a", 2), (5, "t", "a", 2), (6, None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shuffle_key int")
    out = mixing.mix_sources(docs, size=8.0).collect()
    n = Counter((r.doc_id, r.source) for r in out)
    assert n[5, "a"] % 2 == 0 and {len(r.text) for r in out if r.doc_id is None} <= {3_000_000} and out[0].asDict().keys() == {"doc_id", "text", "source", "copy", "shuffle_key"}


def test_mixing_with_more_sources_than_are_broadcast(spark, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 300).cast("string")).alias("source"))
    want = Counter((r.doc_id, r.copy) for r in mixing.mix_sources(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_STEPS", 10)
    assert Counter((r.doc_id, r.copy) for r in mixing.mix_sources(docs).collect()) == want


def test_poisson_inversion(spark):
    means = [0.0, 0.01, 0.7, 3.0, 60.0, 2000.0]
    df = spark.createDataFrame([(m,) for m in means], "m double").select("m", mixing.poisson_steps(F.col("m")).alias("s"))
    for r in df.collect():
        if r.m == 0:
            assert r.s == [1.0]
            continue
        p = [math.exp(k * math.log(r.m) - r.m - math.lgamma(k + 1)) for k in range(len(r.s))]
        total = 0
        for a, b in zip(r.s, p, strict=True):
            total += b
            assert abs(a - total) < 1e-9
        assert r.s[-1] > 1 - 1e-12


def brute_rules(text):
    import re

    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    seen, covered = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered |= {i + k for i in places for k in range(8)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_against_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", "\n\n", " \x0b\x0c", "é #*$ 😀", "a b c d e f g h " * 3, "x\ny\nx\n x\n", "w " * 30000, "    z"]
    texts += [" ".join(rng.choice(["a", "b", "c.", "d|", "\n"]) for _ in range(rng.randint(0, 120))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, 3, True, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, kept boolean, _text string")
    rows = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(t or ""), repr(t)[:100]
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_line_rules(spark):
    lines = ["A clean sentence stands here.", "Home | About | Contact | Help.", "no end mark", "All rights reserved by us.", "so### much%%% noise&&& here.", "", "It ends so!", "See “this.”"]
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    assert quality_rules.clean_lines(df).first().clean_text == "\n".join([lines[0], "", "It ends so!", lines[7]])


INSIDE = ["row", "_row", "_text", "_words", "_lines", "_windows", "_sorted", "_hits", "line_kept_", "_source", "_n", "_weight", "_mean", "_parts", "_part", "_steps", "_salt", "_u", "_times", "_label", "label", "known", "new"]


@pytest.mark.parametrize("most", [mixing.BROADCAST_STEPS, 0])
def test_callers_columns_of_any_name_stay(spark, monkeypatch, most):
    """Columns named like those used inside come back whole from the rules, the mixing and the language labels."""
    monkeypatch.setattr(mixing, "BROADCAST_STEPS", most)
    schema = ", ".join(["doc_id long", "text string", "source string", *[f"`{c}` string" for c in INSIDE]])
    docs = spark.createDataFrame([(i, "Some words stand here. " * 9, "a", *[f"{c}{i}" for c in INSIDE]) for i in range(3)], schema)
    want = {tuple(r) for r in docs.collect()}
    for out, new in ((quality_rules.quality_rules(docs), 9), (mixing.mix_sources(docs, size=40.0), 2), (langid.identify(docs, langid.fit([], [])), 2)):
        assert out.columns[:-new] == docs.columns and {tuple(r)[:-new] for r in out.collect()} == want
