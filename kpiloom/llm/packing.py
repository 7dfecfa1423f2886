"""Packing along a space-filling curve.

Every document is a vector of hashed token counts, projected to three dimensions. The Hilbert curve
through that cube gives one key a document, and documents that are near in the cube are mostly near on
the curve. The documents are range-sorted by the key and laid end to end; a sequence is each run of
``capacity`` ids of that line, so neighbours share sequences and only the last one is padded.

The sort and the prefix sums move narrow rows (key, size, row number). The ids are moved once, to
where the positions are.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kpiloom.llm.shared import materialize, run_folder
from kpiloom.llm.tokens import BLOCK_BYTES, DEFAULT_TOKENIZER, encoder

CAPACITY = 4096
END_ID = 2
DIMENSIONS = 3
BITS = 16
BUCKETS = 1024


@functools.cache
def _projection(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each hashed id, and a random direction of each bucket for each dimension."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, BUCKETS, 1 << 16), rng.standard_normal((BUCKETS, DIMENSIONS))


def project(ids: np.ndarray) -> np.ndarray:
    """Coordinates in [0, 2^BITS): the direction of the hashed count vector, evened out by a logistic curve."""
    if not len(ids):
        return np.zeros(DIMENSIONS, np.int64)
    bucket, directions = _projection()
    counts = np.sqrt(np.bincount(bucket[ids.astype(np.int64) & 0xFFFF], minlength=BUCKETS))
    at = counts @ directions / np.sqrt((counts * counts).sum())
    return np.minimum((1 / (1 + np.exp(-1.7 * at)) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of integer coordinates in [0, 2^bits).

    The coordinates are turned, level by level from the top, into the frame of the sub-cube that the
    curve is in; the Gray code of the result is the position, its bits dealt out over the dimensions."""
    x = np.array(points, np.int64).T.copy()
    n = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(n):
            there = (x[i] & level) != 0
            swap = np.where(there, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(there, low, swap)
            if i:
                x[i] ^= swap
        level >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, level = np.zeros_like(x[0]), 1 << (bits - 1)
    while level > 1:
        flip ^= np.where((x[n - 1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= flip
    keys = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            keys = keys << 1 | (x[i] >> b & 1)
    return keys


def _encode(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int,
            block_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    enc, row = encoder(tokenizer), TaskContext.get().partitionId() << 33
    for batch in batches:
        start = 0
        for flat, ends in enc.encode(batch.column("text"), block_bytes):
            cuts = [0, *ends.tolist()]
            ids = [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            keys = hilbert_keys(np.array([project(x) for x in ids]).reshape(-1, DIMENSIONS))
            tail = np.array([end_id], enc.dtype).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(ids))), batch.column("doc_id").slice(start, len(ids)),
                 pa.array(keys), pa.array([len(x) + 1 for x in ids], pa.int64()),
                 pa.array([enc.dtype.itemsize] * len(ids), pa.int32()), pa.array([x.tobytes() + tail for x in ids], pa.binary())],
                names=["row", "doc_id", "key", "n", "width", "ids"])
            start += len(ids)
            row += len(ids)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids before each row within its range."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        ends = before + np.cumsum(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array([part] * len(n), pa.int32()), pa.array(ends - n), pa.array(n)],
            names=["row", "part", "inside", "n"])
        before = int(ends[-1]) if len(ends) else before


def _pieces(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for d, (at, width, ids) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("at", "width", "ids")), strict=True)):
            wide = np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()
            start, n = 0, len(wide) // 4
            while start < n:
                length = min(n - start, capacity - (at + start) % capacity)
                crc = zlib.crc32(wide[4 * start:4 * (start + length)])
                for column, value in zip(out, (d, start, length, crc, (at + start) // capacity, (at + start) % capacity), strict=True):
                    column.append(value)
                start += length
        doc = pa.array(out[0], pa.int64())
        start, length, crc, seq, off = (pa.array(c, pa.int64()) for c in out[1:])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(doc), start, length, crc, batch.column("n").take(doc), seq, off],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, *, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = END_ID,
         capacity: int = CAPACITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text; other columns are ignored): doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone. A null doc_id stays null. Repeated rows are documents of
    their own; ties on the curve go by doc_id, then by row number, so equal documents lie side by side
    and a hot key is cut into several ranges. A text of any length is cut into as many pieces as it
    needs. An empty table gives no rows.

    ``block_bytes``: texts that a worker encodes at once; smaller blocks take less memory and more time."""
    folder = run_folder(docs.sparkSession, "pack")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    encoded = materialize(docs.select("doc_id", "text").mapInArrow(
        lambda b: _encode(b, tokenizer, end_id, block_bytes), f"row long, doc_id {id_type}, key long, n long, width int, ids binary"),
        f"{folder}/ids")
    order = ["key", "doc_id", "row"]
    line = materialize(
        encoded.select(*order, "n").repartitionByRange(*order).sortWithinPartitions(*order).select("row", "n")
        .mapInArrow(_running, "row long, part int, inside long, n long"), f"{folder}/line")
    # one row a range: as many as there are shuffle partitions
    starts = line.groupBy("part").agg(F.sum("n").alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = line.join(F.broadcast(starts), "part").select("row", (F.col("before") + F.col("inside")).alias("at"))
    return encoded.drop("key").join(placed.hint("shuffle_hash"), "row").mapInArrow(
        lambda b: _pieces(b, capacity),
        f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
