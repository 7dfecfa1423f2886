"""Pipeline over ``documents``: language ID, near-duplicates, secrets, mix, packing.

Each stage takes the documents that its predecessor kept, as a table that was written and read again.
SQL cannot express the stages (``ORACLE_SQL`` is None); tests/llm holds them against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kpiloom.llm import langid, mixing, packing, secrets, simhash
from kpiloom.llm.shared import materialize, run_folder

ORACLE_SQL = None

#: Bytes of texts that packing encodes at once. Its workers still hold what the stages before it took, so the
#: blocks are a quarter of those that the operator takes on its own.
PACK_BLOCK_BYTES = 2 << 20


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that holds enough of their letters, go."""
    return langid.keep_known(docs, langid.train(docs, where=~langid.held_out()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: that of the smallest doc_id."""
    return simhash.keep_one(docs)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole epochs and the part up to the cut of each source; documents may repeat."""
    return mixing.apply_mix(docs, mixing.mix(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, block_bytes=PACK_BLOCK_BYTES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("simhash_dedup", near_duplicates),
    ("secret_scan", secret_spans),
    ("mix_sources", source_mix),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
