"""Stages that clean and pack a corpus, each over all that the stage before kept.

All stages but the last return the columns of the documents they are given, whatever further columns those have, and
need only ``doc_id`` and ``text`` (``n_chars`` follows the text where it is there). A table without rows gives one without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raregram.llm import decontam, minhash, packing, pii, quality
from raregram.llm.common import drop_scratch, materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled documents of ``sf_dir``.

    Null texts are judged as empty ones; copies and rows of one id are judged alike, each by its text; a score at the threshold stays.
    """
    model = quality.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one of the least id, of rows alike one.

    Null texts and rows without an id are rows like others, but null texts are nobody's duplicates and stay.
    """
    return minhash.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that are mostly such passages go.

    Null and blank texts hold no passage and stay; rows alike are cut alike; coverage at the limit goes.
    """
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; every row stays, null and blank texts as they are, rows alike alike."""
    out = pii.redact(docs, pii.learn(docs))
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences: of every row, null and empty texts as their end token alone."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: The stages cannot be said in SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_scratch(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
