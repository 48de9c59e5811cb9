"""From raw documents to packed sequences: rejected, near-duplicate and unsampled documents go, personal data is replaced.

Every stage takes null, empty and very long texts, null and repeated doc_ids, empty tables and extra columns of any name;
what becomes of them is told at the operator it calls. All stages but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lagweave.llm import classifier, mixing, packing, pii, simhash
from lagweave.llm.common import table, written
from lagweave.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that score below the threshold go; null and empty ones have the score of the bias."""
    return classifier.good_documents(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays; all texts without words are one group."""
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No row goes; null texts stay null."""
    return pii.redact(docs, pii.train(docs))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows stay by their cell's probability; texts without words go."""
    return mixing.sampled_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows that are left; a text without ids is its end id alone."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("simhash near-dedup", near_duplicates), ("pii", personal_data), ("mixing", mixing_sources), ("packing", packed)]

#: Learned models, fingerprints of words and tokenizers have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
