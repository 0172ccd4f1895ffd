"""A corpus pipeline of four stages; each is written as Parquet and read again as the next one's documents.

Toxic documents are rejected; of each group of near copies the one with the smallest id stays; personal data gives way
to its kind in angle brackets; the rest is packed into windows. Every stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from morpholake.llm import packing, pii, simhash, toxicity
from morpholake.llm.blocks import shared_folder

#: No SQL expresses the hashes, the tokenizer or the fitted model; the stages are tested against brute force.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold. The model is fitted on labelled documents of docs."""
    return toxicity.kept(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, with the smallest id; linked by 0.8 or more of their five-word shingles. Rows without an id all stay."""
    return simhash.one_of_each(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data redacted; n_chars is counted anew."""
    return pii.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, as packed into windows of 2048 tokens."""
    return packing.pack_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", dedup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents; what is between them stays in the folder that the cluster shares (spark.checkpoint.dir)."""
    folder = f"{shared_folder(spark)}/corpus_pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
