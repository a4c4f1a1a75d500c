"""The near-duplicate join against brute force over word shingles."""

import random

import pytest

from packetloom.llm import jaccard

SF = "/root/testdata/sf0.001"


def words_of(t):
    return [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in (t or "")).split(" ") if w]


def shingles(t):
    w = words_of(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k in range(len(rows)):
        least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    return sorted((rows[k][0], least[find(k)] if sets[k][1] else rows[k][0], links[k]) for k in range(len(rows)))


def answer(df):
    return sorted((r.doc_id, r.class_id, r.n_links) for r in df.collect())


def made(seed, groups=12, most=14):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, passage = [], [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 150))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.randint(1, most)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(w))
                w[k : k + 1] = [rng.choice(vocabulary)] * rng.randint(0, 2)
                w = w or ["x"]
            rows.append((rng.choice([" ", "\n"]).join(w)))
    rows += [None, "", "  ", "one", "one", "a b", "a  b", "a\tb"]
    return [(1000 - 3 * i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = made(seed)
    docs = spark.createDataFrame([(i, t, 1, "c", 5) for i, t in rows], "doc_id long, text string, label int, class_id string, n_links int")
    assert answer(jaccard.near_duplicates(docs)) == brute(rows)


def test_blocks_of_a_large_component_lose_no_link(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert answer(jaccard.near_duplicates(docs, block=16)) == brute(rows)


def test_query_over_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert answer(jaccard.query(spark, SF)) == brute(rows)


def test_repeated_rows_and_missing_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "x y z p q r"), (None, "a b c d e f"), (3, None)], "doc_id long, text string")
    got = jaccard.near_duplicates(docs)
    assert answer(got.where("doc_id IS NOT NULL")) == [(1, 1, 1), (1, 1, 1), (2, 2, 0), (3, 3, 0)]
    assert [(r.class_id, r.n_links, r.copies) for r in got.where("doc_id IS NULL").collect()] == [(None, 0, 1)]


def near(text, k):
    """``text`` with the words around place ``k`` changed."""
    w = text.split()
    w[k] = f"y{k}"
    return " ".join(w)


def test_different_texts_under_one_id_keep_their_links(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    rows = [(1, a), (1, b), (2, near(a, 5)), (3, near(b, 70)), (1, "c d e f g h"), (4, "c d e f g h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert answer(jaccard.near_duplicates(docs)) == brute(rows)


def test_deduplicated_keeps_one_row_of_each_group(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    rows = [(1, a, "s"), (1, b, "t"), (1, b, "t"), (2, near(a, 5), "u"), (3, near(b, 70), "v"), (4, None, "w"), (5, "", "w"), (5, "", "w"), (None, a, "x"), (None, a, "x"), (6, "a  b", "y"), (6, "a b", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_key string")
    got = sorted(((r.doc_id, r.text) for r in jaccard.deduplicated(docs).collect()), key=str)
    short = min(["a  b", "a b"], key=lambda t: docs.sparkSession.range(1).select(jaccard.F.xxhash64(jaccard.F.lit(t))).first()[0])
    assert got == sorted([(1, a), (1, b), (4, None), (5, ""), (None, a), (None, a), (6, short)], key=str)
    assert jaccard.deduplicated(docs.limit(0)).count() == 0


def test_very_long_texts(spark):
    long = " ".join(f"w{i % 7919}x{i // 5}" for i in range(60_000))
    rows = [(1, long), (2, near(long, 30_000)), (3, long[: len(long) // 2]), (4, "z" * 300_000), (5, "z" * 300_000)]
    assert answer(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_recall_at_the_threshold(spark):
    """Of 300 pairs just above the threshold, alone in their buckets, all are found."""
    rng = random.Random(3)
    rows = []
    for i in range(300):
        w = [f"p{i}w{k}" for k in range(84)]
        other = list(w)
        for k in (2, rng.randrange(10, 70)):  # changes take three and five shingles from either side
            other[k] = f"q{k}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
    assert all(0.8 <= len(x & y) / len(x | y) < 0.82 for x, y in ((shingles(rows[k][1]), shingles(rows[k + 1][1])) for k in range(0, 600, 2)))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("n_links = 1").count() == 600


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert answer(jaccard.near_duplicates(docs)) == []


def test_pruning_keeps_pairs_at_the_threshold():
    least = jaccard.least_agreements(0.8, 1e-6)
    assert least[12] < 12 * 0.8 and least[jaccard.VALUES] < jaccard.VALUES * 0.8
    assert all(least[n] >= 0 for n in range(jaccard.VALUES + 1))


def test_edges_of_dense_groups_are_thinned(spark):
    from packetloom.llm.components import connected_components, tied_to_least

    # 400 nodes, each tied to 25 lesser ones of a core of 40, beside a path and a few pairs
    rng = random.Random(3)
    pairs = [(100 + i, c) for i in range(400) for c in rng.sample(range(40), 25)] + [(2000 + i, 2001 + i) for i in range(60)] + [(3001, 3000), (3000, 3001), (3005, 3005)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    assert tied_to_least(tied_to_least(edges)).count() < 700 < len(pairs)
    root = {n: n for p in pairs for n in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {n: find(n) for n in root if n != 3005}
    assert {r.node: r.label for r in connected_components(edges).collect()} == want
