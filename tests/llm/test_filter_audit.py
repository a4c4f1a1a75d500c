"""The filter audit: masks and orders against plain loops, planted hash collisions, odd rows."""

import itertools
import re

import numpy as np
import pyarrow as pa

from packetloom.llm import filter_audit as audit
from packetloom.llm import textnum

DOC = "doc_id long, text string, lang string"
LABEL = "doc_id long, quality int, toxic int"


def plain_mask(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    text = text or ""
    fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text))]
    return sum(f << k for k, f in enumerate(fails))


def plain(rows, labels):
    """Each order walked document by document."""
    masks = [plain_mask(t) | (16 if i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, _ in rows) else 0) for i, t, _ in rows]
    mark = {i: [any(j == i and x[k] == 1 for j, *x in labels) for k in (0, 1)] for i, _, _ in rows if i is not None}
    out = {}
    for part in {p or "" for _, _, p in rows}:
        mine = [(m, *mark.get(i, [False, False])) for m, (i, _, p) in zip(masks, rows, strict=True) if (p or "") == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [m for m in left if m[0] & bit]
                redundant = sum(1 for m in mine if m[0] & bit) - len(gone)
                left = [m for m in left if not m[0] & bit]
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(1 for m in mine if m[0] == bit), sum(m[1] for m in gone), sum(m[2] for m in gone)]
                removed_by[letter] += len(gone)
        for key, value in out.items():
            if key[0] == part:
                value.append(removed_by[key[1][key[2] - 1]])
    return out


def got(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_audit_equals_loops(spark):
    many, few = " ".join(f"w{i}" for i in range(250)), "ab cd " * 120
    texts = [None, "", " \t\n", many, many.upper(), few, few + "#", "Ünï|cödé É " * 90, many + " 50%", "x y z", "A" * 700_000, "\0 a\x1cb"]
    rows = [(i, t, ["en", None, "", "de"][i % 4]) for i, t in enumerate(texts * 2)]
    rows += [(3, many, "en"), (3, many, "en"), (None, many, "fr"), (None, None, "fr"), (2, few, "fr")]
    labels = [(i, i % 2, i % 3 // 2) for i in range(20)] + [(3, 0, 1), (3, None, None), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 5, "q") for r in rows], DOC + ", mask int, digest string")
    assert got(audit.filter_audit(docs, spark.createDataFrame(labels, LABEL))) == plain(rows, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOC), spark.createDataFrame([], LABEL)
    assert audit.filter_audit(docs, labels).count() == 0
    assert got(audit.filter_audit(spark.createDataFrame([(1, None, None)], DOC), labels)) == plain([(1, None, None)], [])


def test_words_with_equal_hashes_are_told_apart():
    w = textnum.words(pa.array(["a b a b c a", "b b", "", "aa b aa"]))
    assert audit.distinct_words(w, 4).tolist() == [3, 1, 0, 2]
    assert audit.distinct_words(w._replace(hashes=np.zeros_like(w.hashes)), 4).tolist() == [3, 1, 0, 2]


def test_failures_keep_other_columns(spark):
    docs = spark.createDataFrame([(1, "x", "m", 2.5)], "id long, text string, Mask string, n_words double")
    out = audit.failures(docs).collect()[0].asDict()
    assert out.keys() == {"id", "n_words", "mask", "digest"} and out["mask"] == 1 and out["n_words"] == 2.5
