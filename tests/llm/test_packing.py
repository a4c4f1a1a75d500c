"""Token pieces and their packing, by exact round trip."""

import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from packetloom.llm import packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def check(rows, texts, tokenizer, size=2048):
    """Pieces join to each text's ids; sequences have no gaps and no overflow."""
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, r in enumerate(sorted(by_doc.pop(i), key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and 1 <= r.length <= size
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + r.length]))
            at += r.length
        assert at == len(ids) and (len(ids) <= size) == (k == 0)
    assert not by_doc
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(seqs)


def test_query_over_the_whole_table(spark, tokenizer):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = packing.query(spark, SF).collect()
    n = check(rows, texts, tokenizer)
    assert n <= 1.01 * sum(r.length for r in rows) / 2048 + 1


def test_odd_texts(spark, tokenizer):
    texts = [None, "", " ", "<|endoftext|>", "é" * 3000, "a" * 9000, "\n" * 5000, "x y " * 2047, "😀 \u0000 z", "word " * 2046, "word " * 2047, "word " * 2048]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, length int, piece int")
    packed = packing.pack_documents(docs)
    check(packed.collect(), rows, tokenizer)
    whole = {r.sequence_id: r.ids for r in packing.sequences(docs, packed).collect()}
    for r in packed.collect():
        assert zlib.crc32(whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)]) == r.ids_crc32


def test_repeated_rows_get_places_of_their_own(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 700, "doc_id long, text string")
    rows = packing.pack_documents(docs).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 700


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_plans_use_up_all_pieces(seed):
    rng = random.Random(seed)
    numbers = dict(Counter(rng.choice([rng.randint(1, 100), rng.randint(1, 30), 100]) for _ in range(rng.randint(1, 400))))
    used = Counter()
    for times, filling in packing.plan_bins(numbers, 100):
        assert times > 0 and sum(filling) <= 100
        for x in filling:
            used[x] += times
    assert used == numbers


def test_two_smaller_pieces_replace_the_smallest():
    # greedy takes 60 + 30 and leaves 10; 25 + 15 in place of 30 fill the bin
    first = packing.plan_bins({60: 1, 30: 1, 25: 1, 15: 1}, 100)[0]
    assert first == (1, [60, 25, 15])


def test_a_length_in_many_buckets(spark):
    pieces = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") % 3 == 0, 7).otherwise(100).cast("long").alias("length"))
    rows = packing.pack(pieces, 100, spread=100).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 5000
    assert max(r.sequence_id for r in rows) + 1 == len({r.sequence_id for r in rows})


def test_added_tokens_are_one_id(spark, tmp_path):
    """The query gives the ids of the tokenizer with its default settings."""
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>\n x", "x<|endoftext|", "word " * 2046 + "<|endoftext|>", None]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    default = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check(packing.query(spark, str(tmp_path)).collect(), rows, default)
    assert packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), True)(texts[0]) == [64, 220, 50256, 275]


def test_every_code_point_gives_the_default_tokenizer_s_ids():
    """Classes of characters, spaces and contractions are cut alike, wherever the added token stands."""
    default = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), True)
    points = [*range(0xD800), *range(0xE000, 0x10000), *range(0x10000, 0x110000, 97)]
    texts = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)}\n{chr(c)} 's{chr(c)}'ll" for c in points]
    rng = random.Random(1)
    bits = [" ", "  ", "\n", "\r\n", "\t", " ", "a", "Bc", "é", "日本", "😀", "1", "½", "'s", "'LL", "_", "<|endoftext|>", "<|endo", "‍", "\x00", "\x85"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(5000)]
    for first in range(0, len(texts), 5000):
        part = texts[first : first + 5000]
        assert [encode(t) for t in part] == [e.ids for e in default.encode_batch(part, add_special_tokens=False)]


def test_long_runs_of_white_space(spark, tokenizer):
    """A run that the pattern can't walk back over gives the default tokenizer's ids, beside text and special tokens."""
    encode, plain = packing.encoder(public_tokenizers.path(packing.VOCABULARY), added=True), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    blanks = "\t\n\v\f\r \x85\xa0        　"
    rng = random.Random(6)
    for n in (999, 1000, 1001, 2500):
        for run in (" " * n, "\n" * n, "".join(rng.choices(blanks, k=n)), "".join(rng.choices(" \n", k=n)) + "\n"):
            for before, after in (("", ""), ("a", "b"), ("", "é"), ("x.", "<|endoftext|>"), ("<|endoftext|>", "\x1c1"), ("y​", "​z " + run + "w")):
                text = before + run + after
                assert encode(text) == plain.encode(text, add_special_tokens=False).ids
    text = "a" + " " * 1_000_000 + "b" + " \n" * 300_000
    assert encode(text) == plain.encode(text, add_special_tokens=False).ids
    rows = [(1, "\n" * 2_000_000), (2, " " * 10_000_000), (3, "a" + " \n\t" * 1_000_000 + "b")]
    packed = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    total = {i: sum(r.length for r in packed if r.doc_id == i) for i, _ in rows}
    assert total == {1: 1_000_001, 2: 10_000_001, 3: len(encode(rows[2][1])) + 1}
