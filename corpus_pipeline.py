"""The corpus pipeline: toxicity, SimHash near-duplicates, secrets, mixing, BPE. Each stage's rows are the next one's documents.

Stages get what their predecessor kept, with the columns of documents; the last returns ids and the decoded text.
The toxicity model is learned from the labelled rows of the stage's own input. Near-duplicates come from op10's SimHash trees and are compared
over five-word shingles; those that 64 bits can't see are found by the shingles.

In every stage texts are read as a whole, however long; extra columns pass through, whatever they are called, up to the last
stage; an empty table gives an empty table. What else each does with nulls, repeats and ties stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hopweave.llm import bpe, mixing, secrets, simhash, toxicity
from hopweave.llm.common import materialize, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the grammar scores 0.5 or more, each by its own text: null and empty texts score like an empty one,
    equal texts go or stay together, null and repeated doc_ids make no difference."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that of the smallest doc_id, nulls last, then of the smallest digest of
    its text. Rows that repeat doc_id and text leave one; a repeated doc_id with an unlike text keeps both; texts without words,
    null or not, are one group."""
    return simhash.drop_similar(docs, words=5, similarity=0.8)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets within the texts; every row stays, null texts as they are."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that each source comes near its target weight. Texts without words, null or not, have no
    size and aren't taken; null sources are one source; rows that repeat doc_id and text are taken together."""
    return mixing.mixed(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and what they decode to: doc_id, ids, decoded. Every row stays; null texts count as empty."""
    return bpe.encode(docs)


STAGES = [("toxicity", toxicity_stage), ("simhash near-dedup", dedup_stage), ("secret scans", secrets_stage), ("mixing to target weights", mixing_stage), ("bpe encoding and decoding", bpe_stage)]

#: Learned scores, fingerprints and byte-pair merges have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
    return docs
