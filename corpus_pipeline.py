"""Documents to packed training sequences, in five stages.

Each stage is one of the operators of ``packetloom.llm``. It takes the documents that
its predecessor kept and returns documents; the last returns the token pieces' places.
Every stage takes whole texts of any length and gives no rows for an empty table. Of
the columns of ``docs`` it needs those of ``COLUMNS`` and drops all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import jaccard, mixing, nbsvm, packing, pii
from packetloom.llm.scratch import new_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from those of ``docs`` that have labels.

    Null and empty texts get the model's base score; a score of exactly 0.7 is accepted;
    repeated rows and equal texts stay or go together; a null doc_id or label teaches nothing.
    """
    model = nbsvm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return nbsvm.classify(docs, model).where("predicted = 1").select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id; of its repeated rows, one.

    Of several texts under that id one stays. Documents without words, with a null text or
    without doc_id are in no group and stay, but for repeated rows of one with a doc_id.
    """
    return jaccard.deduplicated(docs.select(*COLUMNS))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by ``<kind>``, n_chars counted anew.

    Rows stay, null texts too, with n_chars null; of spans that overlap one kind is written.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in equal shares, as many documents on average as there were.

    A null source is one of its own. Rows of one doc_id are drawn alike; a null doc_id
    counts as an id. Texts are not looked at.
    """
    return mixing.mix_sources(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token piece's sequence and place. A null text is one token; repeated rows get places of their own."""
    return packing.pack_documents(docs, added=True)


STAGES = [("quality classifier", quality), ("near duplicates", deduplicate), ("personal data", redact), ("source mixing", mix), ("packing", pack)]

#: A trained model, a similarity join and a tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each is written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = new_path(spark, f"pipeline-{i}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
