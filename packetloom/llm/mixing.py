"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

The weight of a source and the wanted size give a mean number of repetitions of its
documents. A uniform number from the hash of the seed and the document's id is put
through the inverse of the Poisson distribution with that mean, the document is
repeated so often, and all copies are ordered by another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A document with a larger mean is drawn in parts of at most this mean, which are Poisson too; their copies are numbered apart.
PART_MEAN, PART_COPIES = 256, 1024
#: Doubles in the table of distributions (32 MiB) up to which it is broadcast; a larger one is joined on source and salt.
BROADCAST_STEPS = 4 << 20
SALTS = 64


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of an MD5 over seed and parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_steps(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... for a mean of at most some hundreds, as far as the tail matters to a double."""
    most = F.ceil(mean + 10 * F.sqrt(mean) + 20).cast("int")

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.log(mean) - F.log(k.cast("double"))
        total = acc["total"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"), F.concat(acc["steps"], F.array(total)).alias("steps"))

    zero = F.struct((-mean).alias("log_p"), F.exp(-mean).alias("total"), F.array(F.exp(-mean)).alias("steps"))
    steps = F.aggregate(F.sequence(F.lit(1), most), zero, step, lambda acc: acc["steps"])
    return F.when(mean > 0, steps).otherwise(F.array(F.lit(1.0)))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, seed: int = 11, source: str = "source") -> DataFrame:
    """All columns of ``docs``, each row as often as its source's rate says, with ``copy`` (from 0) and ``shuffle_key``, in the order of that key.

    ``weights``: a share for each source, made to sum to 1; sources without one are left
    out. None: equal shares for all. ``size``: wanted rows as a multiple of those of
    ``docs``. The mean for a source is share * size * all rows / its rows. A null source
    is a source of its own. Equal rows are drawn alike. An empty table gives an empty
    one. Columns named copy or shuffle_key are replaced, all others stay, whatever their
    names. Texts are not looked at.

    A source with a mean of more than ``PART_MEAN`` is drawn in equal parts: a sum of
    Poisson numbers is one. Part p of a document numbers its copies from 1024 p on, and the
    parts are dealt to tasks before they are repeated, so a rare source's few rows are
    repeated by all tasks.

    Sources are counted with partial aggregates. Their distributions, at most some 440
    numbers each, are broadcast while they hold ``BROADCAST_STEPS`` numbers in all; beyond
    that they are joined on source and salt, so no source's rows meet in one task.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {"copy", "shuffle_key"}]
    name = F.coalesce(F.col(f"`{source}`"), F.lit("\0"))
    docs = docs.select(F.struct(*rest).alias("row"), name.alias("_source"), F.col("doc_id"))
    counts = docs.groupBy("_source").agg(F.count("*").alias("_n"))
    if weights is not None:
        listed = docs.sparkSession.createDataFrame([(k if k is not None else "\0", float(v)) for k, v in weights.items()] or [("", 0.0)], "_source string, _weight double")
        counts = counts.join(listed, "_source")
    else:
        counts = counts.withColumn("_weight", F.lit(1.0))
    rows = docs.count()
    weight = counts.agg(F.sum("_weight")).first()[0]
    mean = F.col("_weight") / F.lit(float(weight or 1.0)) * F.lit(float(size * rows)) / F.col("_n")
    parts = F.greatest(F.lit(1), F.ceil(F.col("_mean") / PART_MEAN).cast("int"))
    rates = counts.withColumn("_mean", mean).withColumn("_parts", parts)
    rates = rates.select("_source", "_parts", poisson_steps(F.col("_mean") / F.col("_parts")).alias("_steps"))
    if (rates.agg(F.sum(F.size("_steps"))).first()[0] or 0) <= BROADCAST_STEPS:
        drawn = docs.join(F.broadcast(rates), "_source")
    else:
        rates = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        drawn = docs.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(rates, ["_source", "_salt"]).drop("_salt")
    drawn = drawn.drop("_source")
    many = drawn.where("_parts > 1").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = many.repartition(tasks, F.xxhash64("doc_id", "_part"))
    drawn = drawn.where("_parts = 1").withColumn("_part", F.lit(0)).unionByName(many).drop("_parts")
    # The first part's number is that of a document drawn whole.
    u = F.when(F.col("_part") == 0, uniform(seed, F.col("doc_id"))).otherwise(uniform(seed, F.col("doc_id"), F.col("_part")))
    drawn = drawn.withColumn("_u", u).withColumn("_times", F.size(F.filter("_steps", lambda p: p <= F.col("_u")))).drop("_steps", "_u").where("_times > 0")
    first = F.col("_part") * PART_COPIES
    drawn = drawn.withColumn("copy", F.explode(F.sequence(first, first + F.col("_times") - 1))).drop("_times", "_part")
    key = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string")).cast("binary"))
    return drawn.withColumn("shuffle_key", key).orderBy("shuffle_key").select("row.*", "copy", "shuffle_key")


def query(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
WITH n AS (SELECT source, count(*) AS n, (SELECT count(*) FROM documents) AS all_rows FROM documents GROUP BY source),
r AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM n)::DOUBLE * all_rows::DOUBLE / n::DOUBLE AS mean FROM n),
p AS (
  SELECT source, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS total
  FROM r, range(0, 400) t(k)
),
d AS (
  SELECT *, ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents
),
c AS (
  SELECT d.*, (SELECT count(*) FROM p WHERE p.source = d.source AND p.total <= d.u) AS times FROM d
)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy,
       md5('order11:' || coalesce(doc_id::VARCHAR, '') || ':' || copy::VARCHAR) AS shuffle_key
FROM (SELECT *, unnest(range(0, times)) AS copy FROM c WHERE times > 0)
"""
