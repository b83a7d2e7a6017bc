"""The queries of this subpackage: each applies one operator to its whole table. ORACLE: their SQL, where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from hopweave.llm import ann, bpe, licenses, mixing, oracle, packing, quality, secrets, sharding, simhash, toxicity
from hopweave.llm.common import table


def op1_quality_ledger(spark, sf_dir):
    return quality.verdicts(quality.ledger(table(spark, sf_dir, "documents")))


def op2_secret_battery(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


def op3_toxicity_grammar(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_mix_sources(spark, sf_dir):
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op5_adaptive_scan(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


def op6_best_fit_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


def op7_shard_differencing(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_bpe_chunks(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"))


def op9_license_inheritance(spark, sf_dir):
    """Documents have no path, so each stands in source/lang/ under its doc_id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.with_inheritance(docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text")).withColumnRenamed("id", "doc_id")


def op10_simhash_components(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_ledger, op2_secret_battery, op3_toxicity_grammar, op4_mix_sources, op5_adaptive_scan, op6_best_fit_packing, op7_shard_differencing, op8_bpe_chunks, op9_license_inheritance, op10_simhash_components)}

ORACLE: dict[str, str] = {"op1_quality_ledger": oracle.OP1, "op4_mix_sources": oracle.OP4}
