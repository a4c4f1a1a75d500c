"""How far the words of each source lie from those of every other source of its language.

Each language's terms are dealt into buckets, and each source's counts in a bucket are one
compressed vector, a block. Blocks stay in the partitions of a bucketed table while copies
of them circulate: in each round of a round-robin tournament every source of a language
meets one other, and a meeting is evaluated in both directions where one of the two lies.
Heaps of each block keep the terms that mark a source against its language. All arithmetic
is on integers.
"""

from __future__ import annotations

import heapq
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Runs of ASCII letters and of all code points beyond ASCII, as UTF-8 bytes.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCALE = 1_000_000_000
_FLUSH = 300_000  # terms that a task counts before it hands them on


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows of ``lang, source, term, n, docs``, not yet summed up, and one with a null term for each group seen.

    Null text, language or source is the empty string. A to Z are lower-cased, no other letter.
    """
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])

    def counted(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def rows_of():
            for (lang, source), (n, docs) in held.items():
                terms = [None, *n]
                columns = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                mine = Counter(TERM.findall(text.encode().lower()))  # lower() of bytes changes A to Z alone
                size -= len(n)
                n.update(mine)
                docs.update(mine.keys())
                size += len(n)
                if size > _FLUSH:
                    yield from rows_of()
                    held, size = {}, 0
        yield from rows_of()

    return rows.mapInArrow(counted, "lang string, source string, term string, n long, docs long")


def probabilities(counts: np.ndarray, total: np.ndarray | int, vocabulary: int) -> np.ndarray:
    """``1 + floor(SCALE * (count + 1) / (total + vocabulary))``, exact for any counts below 2 ** 53."""
    whole, below = counts.astype(np.int64) + 1, np.asarray(total, np.int64) + np.int64(vocabulary)
    if not len(whole) or whole.max() <= np.iinfo(np.int64).max // SCALE:
        return 1 + whole * SCALE // below
    out, rest = whole // below, whole % below
    for _ in range(3):  # long division, three digits at a time
        out, rest = out * 1000 + rest * 1000 // below, rest * 1000 % below
    return 1 + out


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q  # at most 10 ** 18


def _packed(x: np.ndarray) -> bytes:
    return zlib.compress(x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)).tobytes(), 1)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(data)
    return np.frombuffer(raw, f"u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


BLOCK = "lang string, bucket int, slot int, n int, ids binary, counts binary, n_terms int, source string, item string, value long"


def _blocks(top: int):
    """For one bucket of a language: each source's block, and its best terms by a heap."""

    def run(key, table):
        lang, bucket = (k.as_py() for k in key)
        coded = table["term"].combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ids, slots = rank[coded.indices.to_numpy()], table["slot"].to_numpy()
        by = np.lexsort((ids, slots))
        ids, slots = ids[by], slots[by]
        n, n_lang, total = (table[c].to_numpy()[by] for c in ("n", "n_lang", "total"))
        vocabulary, of_lang = table["vocabulary"][0].as_py(), table["total_lang"][0].as_py()
        p, q = probabilities(n, total, vocabulary), probabilities(n_lang, of_lang, vocabulary)
        value = distances(p, q)
        sources, terms = table["source"].combine_chunks().take(pa.array(by)), coded.dictionary
        first = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
        out = []
        for a, b in zip(first, [*first[1:], len(slots)], strict=True):
            deltas = np.diff(ids[a:b], prepend=0)
            out.append((lang, bucket, int(slots[a]), b - a, _packed(deltas), _packed(n[a:b]), len(order), None, None, None))
            over = a + np.flatnonzero(p[a:b] > q[a:b])
            best = heapq.nsmallest(top, zip((-value[over]).tolist(), ids[over].tolist(), strict=True))  # ids are in the order of the terms
            out += [(lang, bucket, None, None, None, None, None, sources[int(a)].as_py(), terms[int(order[i])].as_py(), -v) for v, i in best]
        names = [c.split()[0] for c in BLOCK.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.string(), pa.string(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def partner(slot: Column, sources: Column, turn: int) -> Column:
    """The slot that ``slot`` meets in a round, by the circle method; null for a bye or when all rounds are over."""
    even = sources + F.pmod(sources, F.lit(2))
    last = even - 1
    across = F.pmod(F.lit(turn) - slot, last)
    found = F.when(slot == last, F.pmod(F.lit(turn) * (even / 2).cast("int"), last)).when(across == slot, last).otherwise(across)
    return F.when((F.lit(turn) < last) & (found < sources), found)


def _meet(n_terms, vocabulary, total, n, ids, counts, v_total, v_n, v_ids, v_counts):
    """Both distances of two blocks, each made dense over the terms of their bucket."""
    here, there = [], []

    def dense(width, v, total, n, ids, counts):
        out = np.zeros(width, np.int64)
        if n:
            out[np.cumsum(_unpacked(ids, n))] = _unpacked(counts, n)
        return probabilities(out, total, v)

    for width, v, *both in zip(*(c.to_pylist() for c in (n_terms, vocabulary, total, n, ids, counts, v_total, v_n, v_ids, v_counts)), strict=True):
        p, q = dense(width, v, *both[:4]), dense(width, v, *both[4:])
        here.append(int(distances(p, q).sum()))
        there.append(int(distances(q, p).sum()))
    return pa.StructArray.from_arrays([pa.array(here, pa.int64()), pa.array(there, pa.int64())], ["here", "there"])


def _meetings(blocks: DataFrame, turn: int) -> DataFrame:
    """``lang, source, item, value`` of one round, for each bucket and both directions."""
    # Each block has one meeting at most; of its two blocks the one with the higher slot travels in even rounds, the other in odd ones.
    host = partner(F.col("slot"), F.col("sources"), turn)
    goes = F.col("slot") > host if turn % 2 == 0 else F.col("slot") < host
    guests = blocks.where(goes).select("lang", "bucket", host.alias("slot"), F.col("source").alias("item"), *[F.col(c).alias(f"v_{c}") for c in ("total", "n", "ids", "counts")])
    met = blocks.join(guests, ["lang", "bucket", "slot"])
    meet = F.arrow_udf(_meet, "struct<here: bigint, there: bigint>")
    met = met.select("lang", "source", "item", meet("n_terms", "vocabulary", "total", "n", "ids", "counts", "v_total", "v_n", "v_ids", "v_counts").alias("value"))
    ways = F.array(F.struct("source", "item", F.col("value.here").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("value.there").alias("value")))
    return met.select("lang", F.inline(ways))


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 3, top: int = 200, rows_per_bucket: int = 100_000, rounds_per_job: int = 8) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances to the other sources, and the terms that mark a source.

    Part ``pair``: each other source of the language and the sum over all terms of the
    language of (p - q)^2 / q, rounded down for each term, p the source's and q the other's
    scaled probability. Part ``term``: the ``top`` terms that are likelier in the source than
    in the language. A language's terms are those in at least ``min_docs`` of its documents;
    repeated rows are documents of their own. Null text, language and source are empty
    strings; sources without terms take part; a source alone in its language has no pairs; an
    empty table gives no rows. Ties are in the order of UTF-8 bytes. Other columns are not read.

    Tasks count terms before the shuffle, so a source with a third of all text is a few
    counts from each task. A bucket has about ``rows_per_bucket`` counts of a language,
    whatever the vocabulary. Rounds run ``rounds_per_job`` at a time, and a job writes one
    sum for each pair.
    """
    spark = docs.sparkSession
    dealt = term_counts(docs, text, lang, source).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    counts = dealt.select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("n_lang"), F.sum("docs").over(of_term).alias("in_docs"), (F.row_number().over(of_term.orderBy("source")) == 1).alias("first"))
    counts = scratch.stage(counts.where(F.col("term").isNull() | (F.col("in_docs") >= min_docs)).drop("in_docs"), "counts", "zstd")

    of_lang = Window.partitionBy("lang")
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("term").alias("rows"), F.count_if(F.col("first") & F.col("term").isNotNull()).alias("firsts"))
    groups = groups.select(
        "lang", "source", "total", F.sum("total").over(of_lang).alias("total_lang"), F.sum("firsts").over(of_lang).alias("vocabulary"), F.count("*").over(of_lang).cast("int").alias("sources"),
        (F.row_number().over(of_lang.orderBy("source")) - 1).alias("slot"), F.ceil(F.greatest(F.lit(1), F.sum("rows").over(of_lang)) / rows_per_bucket).cast("int").alias("buckets"),
    )
    groups = scratch.stage(groups, "groups")
    terms = counts.where(F.col("term").isNotNull()).join(groups, ["lang", "source"])
    bucket = F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int")
    made = terms.select("lang", "source", "term", "n", "n_lang", "total", "total_lang", "vocabulary", "slot", bucket.alias("bucket"))
    made = scratch.stage(made.groupBy("lang", "bucket").applyInArrow(_blocks(top), BLOCK), "blocks", "zstd")

    # Every source has a block in every bucket of its language, empty ones included.
    sizes = made.where(F.col("slot").isNotNull()).groupBy("lang", "bucket").agg(F.max("n_terms").alias("n_terms"))
    places = groups.select("lang", "source", "slot", "sources", "total", "vocabulary", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"))
    places = places.join(sizes, ["lang", "bucket"], "left").withColumn("n_terms", F.coalesce("n_terms", F.lit(0)))
    full = made.where(F.col("slot").isNotNull()).select("lang", "bucket", "slot", "n", "ids", "counts")
    blocks = places.join(full, ["lang", "bucket", "slot"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    keys = ["lang", "bucket", "slot"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"packetloom_{uuid.uuid4().hex}"
    blocks.repartition(parts, *keys).write.bucketBy(parts, *keys).sortBy(*keys).option("path", scratch.new_path(spark, "resident")).saveAsTable(name)
    resident = spark.table(name)
    most = groups.agg(F.max("sources")).first()[0] or 0
    sums = []
    rounds = list(range(most + most % 2 - 1)) if most > 1 else []
    for at in range(0, len(rounds), rounds_per_job):
        met = None
        for turn in rounds[at : at + rounds_per_job]:
            met = _meetings(resident, turn) if met is None else met.unionByName(_meetings(resident, turn))
        sums.append(scratch.stage(met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "meetings"))
    spark.sql(f"DROP TABLE {name}")

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = made.where(F.col("slot").isNull()).select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank")).where(F.col("rank") <= top)
    for pairs in sums:  # a pair meets once
        met = pairs if pairs is sums[0] else met.unionByName(pairs)
    if not sums:
        return best
    return best.unionByName(met.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank")))


def query(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), g AS (
  SELECT DISTINCT lang, source FROM d
), w AS (
  SELECT lang, source, term, rid, count(*) AS n FROM (SELECT lang, source, rid, unnest(terms) AS term FROM d) GROUP BY lang, source, term, rid
), v AS (
  SELECT lang, term, sum(n) AS n FROM w GROUP BY lang, term HAVING count(*) >= 3
), vn AS (
  SELECT lang, count(*) AS voc, sum(n) AS total FROM v GROUP BY lang
), c AS (
  SELECT g.lang, g.source, v.term, coalesce(x.n, 0) AS n, v.n AS n_lang
  FROM g JOIN v USING (lang) LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM w GROUP BY lang, source, term) x ON x.lang = g.lang AND x.source = g.source AND x.term = v.term
), t AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source) AS mine FROM c
), p AS (
  SELECT t.lang, t.source, t.term, t.n, (1 + (1000000000::HUGEINT * (t.n + 1)) // (t.mine + vn.voc))::BIGINT AS p, (1 + (1000000000::HUGEINT * (t.n_lang + 1)) // (vn.total + vn.voc))::BIGINT AS q
  FROM t JOIN vn USING (lang)
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM v)
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
