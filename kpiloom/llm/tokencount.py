"""Token counts with a digest cache.

Texts are normalised (runs of ASCII white space become one blank, the ends are trimmed; no listed
tokenizer with ``space_neutral`` counts differently for it) and digested. The digest and the
tokenizer's version are joined to stored counts; only distinct texts without a stored count are
encoded, and their counts are appended to the cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.llm.shared import materialize, run_folder
from kpiloom.llm.tokens import DEFAULT_TOKENIZER, encoder, tokenizer_digest

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def normalised(text: Column, space_neutral: bool) -> Column:
    """Null is the empty text. Without ``space_neutral`` every character counts."""
    text = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(text, r"[\t-\r ]+", " ")) if space_neutral else text


def _count(batches: Iterator[pa.RecordBatch], tokenizer: str, version: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(tokenizer)
    for batch in batches:
        counts = np.concatenate([np.diff(ends, prepend=0) for _, ends in enc.encode(batch.column("content"))]
                                or [np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("digest"), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())],
            names=["digest", "tokenizer", "n_tokens"])


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Stored counts; a cache that does not exist yet is empty."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return (spark.read.schema(CACHE_SCHEMA).parquet(path) if there
            else spark.createDataFrame([], CACHE_SCHEMA))


def token_counts(docs: DataFrame, *, cache: str | None = None, tokenizer: str = DEFAULT_TOKENIZER,
                 space_neutral: bool | None = None, limit: int = 2048) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_bytes (UTF-8),
    n_tokens, over_limit (n_tokens > limit).

    ``cache``: Parquet folder of stored counts that outlives the call; None starts an empty one in the
    shared folder. Null text is empty: 0 bytes, 0 tokens. A null doc_id stays null; repeated rows each
    get their row; an empty table gives no rows. ``space_neutral`` may only be True for tokenizers that
    drop white space; None asks the tokenizer (True for the word BPE file, False for sentencepiece models).

    Hot texts: a text's copies are reduced to one per map task before the shuffle (partial
    aggregation), and joins back are over 40-byte rows, which adaptive execution splits if skewed.
    With a cache that holds counts, digests meet it first, and only texts of digests without a count
    are asked for; where these are few, Spark broadcasts them and no other text is moved.
    """
    if space_neutral is None:
        space_neutral = encoder(tokenizer).by_word
    spark = docs.sparkSession
    cache = cache or run_folder(spark, "token-counts")
    version = tokenizer_digest(tokenizer)
    content = normalised(F.col("text"), space_neutral)
    # the JVM digests the content; 32 bytes stand for it in every join
    keyed = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
                        F.unhex(F.sha2(content, 256)).alias("digest"))
    stored = read_cache(spark, cache).filter(F.col("tokenizer") == version).dropDuplicates(["digest"])
    texts = docs.select(content.alias("content")).withColumn("digest", F.unhex(F.sha2("content", 256)))
    if not stored.isEmpty():
        missing = materialize(keyed.select("digest").distinct().join(stored, "digest", "left_anti"),
                              run_folder(spark, "token-misses"))
        texts = texts.join(missing, "digest", "left_semi")
    misses = texts.groupBy("digest").agg(F.first("content").alias("content"))
    misses.mapInArrow(lambda b: _count(b, tokenizer, version), CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = (read_cache(spark, cache).filter(F.col("tokenizer") == version)
              .groupBy("digest").agg(F.first("n_tokens").alias("n_tokens")))
    return keyed.join(counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
