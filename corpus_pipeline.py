"""The corpus pipeline: each stage applies one operator of graphloom.llm to all that its predecessor kept.

Language identification drops documents without a known language; near-duplicate classes keep one document each; contaminated
documents go; secrets are masked in the texts; what is left is tokenised and packed into sequences.
ORACLE_SQL is None, because the language model, the automaton's spans and the packing have no SQL form; tests
compare the stages with brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, langid, near_dup, packing, secrets
from graphloom.llm.common import stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.filter_known(docs, langid.learn(docs.where(~langid.held_out(F.col("doc_id")))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination),
    ("secret_scan", secret_scan), ("best_fit_packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else stored(docs), sf_dir)
    return docs
