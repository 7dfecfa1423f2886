"""The registered query of each operator, with its production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.llm import (covertree, jaccard, langid, lexical, mixing, oracles, packing, quality, resample, secrets,
                         simhash, tokencount, tokenfile, warc)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read_token_files(tokenfile.write_token_files(_table(spark, sf_dir, "documents")))


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs, where=~langid.held_out())
    return langid.predict(docs, model).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "n_spans")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.stored(_table(spark, sf_dir, "documents"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.keeps("base-1")).alias("base_failed"), quality.keeps("clean-1").alias("kept"), "failures")


def op9_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call starts an empty cache, so that its figures are those of encoding every distinct text."""
    return tokencount.token_counts(_table(spark, sf_dir, "documents"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.lexical_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_mix_sources, op2_token_files, op3_simhash_groups, op4_pack_sequences, op5_secret_scan, op6_top_k,
        op7_language_id, op8_quality_rules, op9_warc_archives, op10_token_counts, op11_resample, op12_jaccard_groups,
        op13_lexical_search)
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = oracles.ORACLES
