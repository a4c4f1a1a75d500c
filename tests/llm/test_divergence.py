"""The divergence audit: plain loops, odd rows, every pair meeting once, exact division."""

import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.llm import divergence as dv


def plain(rows, min_docs=3, top=200):
    groups, df, of_lang = {}, defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low))
        groups.setdefault((lang, source), Counter()).update(found)
        df[lang].update(found.keys())
        of_lang[lang].update(found)
    out = set()
    for (lang, source), mine in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]

        def p(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + floor(Fraction(10**9 * (counts[t] + 1), total + len(kept))) for t in kept}

        p1, q1 = p(mine), p(of_lang[lang])
        pairs = []
        for (lang2, other), theirs in groups.items():
            if lang2 == lang and other != source:
                p2 = p(theirs)
                pairs.append((-sum(floor(Fraction((p1[t] - p2[t]) ** 2, p2[t])) for t in kept), other.encode()))
        terms = [(-floor(Fraction((p1[t] - q1[t]) ** 2, q1[t])), t.encode()) for t in kept if mine[t] and p1[t] > q1[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            out |= {(lang, source, part, i.decode(), -v, k) for k, (v, i) in enumerate(sorted(found)[:most], 1)}
    return out


def rows_of(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


@pytest.mark.parametrize("per_bucket, per_job", [(100_000, 8), (7, 2)])
def test_audit_equals_loops(spark, per_bucket, per_job):
    rng = np.random.default_rng(5)
    words = ["a", "B", "ab", "Éa", "éa", "ß", "日本", "x-y", "z_z", "it's", "q", "W"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 12))), ["en", "fr", None, ""][rng.integers(4)], [None, "s1", "s2", "s3", "é", "z"][rng.integers(6)]) for _ in range(160)]
    rows += [("only here", "xx", "s1"), (None, "en", "silent"), ("", "yy", None), ("k " * 50_000, "en", "s1"), ("a b", "de", "s1"), ("a b", "de", "s1"), ("A B", "de", "s2"), ("1 2 3", "de", "none")]
    docs = spark.createDataFrame([(*r, 3, "c") for r in rows], "text string, lang string, source string, n long, term string")
    assert rows_of(dv.divergence(docs, rows_per_bucket=per_bucket, rounds_per_job=per_job)) == plain(rows)
    assert rows_of(dv.divergence(docs, min_docs=1, top=2)) == plain(rows, 1, 2)


def test_empty_and_single(spark):
    schema = "text string, lang string, source string"
    assert dv.divergence(spark.createDataFrame([], schema)).count() == 0
    rows = [("a a b", "en", "s")] * 3
    assert rows_of(dv.divergence(spark.createDataFrame(rows, schema))) == plain(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 8, 20, 33])
def test_every_pair_meets_once(spark, n):
    turns = n + n % 2 - 1
    slots = spark.range(n).select(F.col("id").cast("int").alias("slot"), F.lit(n).alias("sources"))
    met = Counter()
    got = slots.select("slot", *[dv.partner(F.col("slot"), F.col("sources"), t).alias(f"t{t}") for t in range(turns + 2)]).collect()
    for r in got:
        for t in range(turns + 2):
            other = r[f"t{t}"]
            if other is not None:
                assert got[other][f"t{t}"] == r.slot != other and t < turns
                met[r.slot, other] += 1
    assert met == Counter({(a, b): 1 for a in range(n) for b in range(n) if a != b})


def test_exact_division_of_large_counts():
    for counts, total, v in (([0, 5, 10**13, 2**52], 2**52, 10**6), ([9_223_372_035, 9_223_372_036, 9_223_372_037], 10**11, 7), ([0], 0, 1), ([], 5, 5)):
        got = dv.probabilities(np.array(counts, np.int64), total, v)
        assert got.tolist() == [1 + 10**9 * (c + 1) // (total + v) for c in counts]
