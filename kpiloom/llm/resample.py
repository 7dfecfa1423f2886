"""Importance resampling towards a target distribution, over hashed n-grams.

A feature is a run of words; its bucket is its CRC-32 modulo the number of buckets. Bucket counts of the raw
documents and of the target texts give each bucket a gain, the log of the ratio of its smoothed shares. A
document's weight is the sum of its features' gains; with Gumbel noise of its id added, the highest scores are
a sample in proportion to the importance weights.

Texts go through Arrow's kernels: lower-casing, splitting, flattening and dictionary encoding. Shifted
dictionary indices form the runs, each distinct pair gets its CRC once, and gains are taken by bucket and
summed by document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kpiloom.llm.shared import materialize, run_folder
from kpiloom.llm.tokens import blocks
from kpiloom.llm.words import NOT_LETTERS_OR_DIGITS, run_crcs

BUCKETS = 10_000
LONGEST_RUN = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024


def _count(batches: Iterator[pa.RecordBatch], buckets: int, longest: int) -> Iterator[pa.RecordBatch]:
    """One row for each bucket that a task's texts hit."""
    n = np.zeros(buckets, np.int64)
    for batch in batches:
        for block in blocks(batch.column("text")):
            for _, crc in run_crcs(block, NOT_LETTERS_OR_DIGITS, longest):
                n += np.bincount(crc % np.uint32(buckets), minlength=buckets)
    hit = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(n[hit])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, *, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> np.ndarray:
    """Features of all ``texts`` (column text) in each bucket. What reaches the driver is a number for each bucket."""
    rows = (texts.select("text").mapInArrow(lambda b: _count(b, buckets, longest), "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of add-one smoothed shares), target over raw."""
    n = float(len(raw))
    above = (target + 1).astype(np.float64) * (float(raw.sum()) + n)
    below = (raw + 1).astype(np.float64) * (float(target.sum()) + n)
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def _weigh(batches: Iterator[pa.RecordBatch], gains: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start = 0
        for block in blocks(batch.column("text")):
            features, weight = np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
            runs = run_crcs(block, NOT_LETTERS_OR_DIGITS, longest)
            for text, crc in runs:
                ends = np.searchsorted(text, np.arange(len(block) + 1))  # texts come in order
                summed = np.concatenate(([0], np.cumsum(gains[crc % np.uint32(len(gains))])))
                features += np.diff(ends)
                weight += np.diff(summed[ends])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(start, len(block)), pa.array(np.bincount(runs[0][0], minlength=len(block))),
                 pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])
            start += len(block)


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) of an id: its SHA-256 with the seed gives a uniform number. A null id is ''."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def numbered(keys: DataFrame, order: list[Column], folder: str, rows_each: int = 50_000) -> DataFrame:
    """``keys`` (distinct rows, each with its number of ``copies``) with ``ahead``, the copies that come before it.

    Rows are dealt to ranges of the order and written with the range's number, so numbers agree however
    often a task is repeated; sums within a range and of the ranges before it add up."""
    n = keys.count()
    placed = materialize(keys.repartitionByRange(max(1, math.ceil(n / rows_each)), *order)
                         .withColumn("range", F.spark_partition_id()), f"{folder}/ranges")
    outer = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = placed.groupBy("range").agg(F.sum("copies").alias("c")).select(
        "range", F.coalesce(F.sum("c").over(outer), F.lit(0)).alias("before"))
    inner = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("copies").over(inner), F.lit(0))
    return placed.withColumn("inside", inside).join(before, "range").withColumn(
        "ahead", F.col("before") + F.col("inside")).drop("range", "before", "inside")


def resample(docs: DataFrame, target: DataFrame, *, buckets: int = BUCKETS, longest: int = LONGEST_RUN,
             min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED, rows_each: int = 50_000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_features, weight, score,
    rank. ``target`` (text; other columns are ignored) holds the texts whose distribution is wanted.

    Of the documents with at least ``min_words`` words, the ``percent`` of highest score are drawn and get ranks
    from 1; ties go to the smaller id (null: first). Null and empty texts have no features, weight 0, and are not
    drawn if ``min_words`` is above 0. A null id takes the noise of an empty id. Repeated rows count each by
    itself: alike in id, features and score they take consecutive ranks. An empty ``docs`` gives no rows; an empty
    ``target`` is a uniform one. What is broadcast is a number for each bucket."""
    folder = run_folder(docs.sparkSession, "resample")
    gains = bucket_gains(bucket_counts(docs, buckets=buckets, longest=longest),
                         bucket_counts(target, buckets=buckets, longest=longest))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    weighed = docs.select("doc_id", "text").mapInArrow(
        lambda b: _weigh(b, gains, longest), f"doc_id {id_type}, n_words long, n_features long, weight long")
    scored = materialize(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), f"{folder}/scores")

    keys = materialize(scored.filter(F.col("n_words") >= min_words)
                       .groupBy("score", "doc_id", "n_features", "weight").agg(F.count("*").alias("copies")), f"{folder}/keys")
    drawn = percent * (keys.agg(F.sum("copies")).first()[0] or 0) // 100
    order = [F.col("score").desc(), F.col("doc_id"), F.col("n_features"), F.col("weight")]
    block = 10_000  # copies are written out in two steps, so no array grows with them
    rows = (numbered(keys, order, folder, rows_each)
            .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {block}"))))
            .withColumn("copy", F.explode(F.sequence(F.col("block") * block, F.least(
                F.col("copies") - 1, F.col("block") * block + block - 1))))
            .withColumn("rank", F.col("ahead") + F.col("copy") + 1))
    out = ("doc_id", "n_features", "weight", "score")
    return rows.select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).union(
        scored.filter(F.col("n_words") < min_words).select(*out, F.lit(None).cast("long").alias("rank")))
