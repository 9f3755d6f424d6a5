"""A pipeline from raw documents to packed sequences, in five stages.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's documents. All but the last return the columns of ``documents``.

Cases: a stage treats NULLs, empty texts, repeated rows and empty tables as the operator that it calls does (see there);
a document without text fails the quality rules, so the later stages see texts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evenkeel.llm import mixing, packing, repetition, simhash, toxicity
from evenkeel.llm.common import kept_rows, table
from evenkeel.llm.queries import TOKENIZER
from evenkeel.session import workspace

#: Stages three to five have no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; learned from the labels of documents that are not held out."""
    shared = spark.sparkContext.broadcast(toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return kept_rows(docs, lambda texts: shared.value.scores(texts) < 0.5)


def without_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the repetition rules."""
    return kept_rows(docs, repetition.passes)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.deduplicated(docs)


def at_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, a row per document and pass."""
    return mixing.mixed_texts(docs)


def in_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.placement(docs, TOKENIZER)


STAGES = [
    ("toxicity", without_toxic),
    ("quality_rules", without_poor),
    ("simhash_near_dedup", without_near_copies),
    ("mixing", at_weights),
    ("packing", in_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written below the shared folder."""
    docs, folder = table(spark, sf_dir, "documents"), workspace(spark)
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
