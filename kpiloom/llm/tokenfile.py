"""Token-id files: one array of ids, and document boundaries in Elias-Fano form.

A shard holds the ids of its documents one after another, 2 or 4 bytes an id, little-endian. Where
documents end is a rising sequence; it takes about 2 + log2(ids / documents) bits a document: the
low bits packed, the high bits in unary, and one sampled position every ``SAMPLE`` documents so
that select(i) touches a few bytes. Document ids, which rise too, are kept in the same form.

Layout: ids, then the parts of both sequences, then a JSON footer, its length (4 bytes) and MAGIC.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kpiloom.llm.shared import materialize, open_input, open_output, run_folder
from kpiloom.llm.tokens import DEFAULT_TOKENIZER, encoder

MAGIC = b"KTOK0001"
SAMPLE = 512
_BLOCK = 1 << 16
MANIFEST = "shard int, uri string, n_docs long, n_ids long"


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit numbers."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = bytearray()
        for i in range(0, n if bits else 0, _BLOCK):
            part = values[i:i + _BLOCK, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)
            low += np.packbits(part.astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) // 8 + 1 if n else 0, np.uint8)
        np.bitwise_or.at(high, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
        return cls(n, bits, bytes(low), high.tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def parts(self) -> list[bytes]:
        return [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]

    def _lows(self, start: int, stop: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(stop - start, np.uint64)
        first = start * self.low_bits
        bits = np.unpackbits(self.low[first >> 3:(stop * self.low_bits + 7) >> 3], bitorder="little")
        bits = bits[first & 7:][:(stop - start) * self.low_bits].reshape(-1, self.low_bits).astype(np.uint64)
        return (bits << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """values[start:stop]; reads from the sample before ``start`` on."""
        stop = min(stop, self.n)
        if start >= stop:
            return np.zeros(0, np.uint64)
        k = start // SAMPLE
        begin = int(self.samples[k])
        last = stop // SAMPLE + 1
        end = int(self.samples[last]) + 1 if last < len(self.samples) else len(self.high) * 8
        bits = np.unpackbits(self.high[begin >> 3:(end + 7) >> 3], bitorder="little")
        ones = np.flatnonzero(bits[begin & 7:]) + begin
        ones = ones[start - k * SAMPLE:stop - k * SAMPLE]
        highs = (ones - np.arange(start, stop)).astype(np.uint64)
        return highs << np.uint64(self.low_bits) | self._lows(start, stop)

    def select(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.slice(i, i + 1)[0])


class ShardWriter:
    """Appends documents in ascending id order (nulls first) to an open file."""

    def __init__(self, out, dtype: np.dtype):
        self.out, self.dtype, self.lengths, self.ids, self.nulls, self.size = out, dtype, [], [], 0, 0

    def add(self, doc_ids: list[int | None], flat: np.ndarray, lengths: np.ndarray) -> None:
        self.nulls += doc_ids.count(None)
        self.ids += [i for i in doc_ids if i is not None]
        self.lengths.append(lengths)
        self.out.write(flat.astype(self.dtype, copy=False).tobytes())
        self.size += flat.nbytes

    def close(self) -> tuple[int, int]:
        ends = np.cumsum(np.concatenate([*self.lengths, np.zeros(0, np.int64)]))
        ids = np.array(self.ids, np.int64)
        base = int(ids[0]) if len(ids) else 0
        footer = {"width": self.dtype.itemsize, "ids_bytes": self.size, "nulls": self.nulls, "base": base}
        at = self.size
        for name, seq in (("ends", EliasFano.of(ends)),
                          ("doc_ids", EliasFano.of(ids.astype(np.uint64) - np.uint64(base % (1 << 64))))):
            sizes = []
            for part in seq.parts():
                self.out.write(part)
                sizes.append([at, len(part)])
                at += len(part)
            footer[name] = {"n": seq.n, "low_bits": seq.low_bits, "parts": sizes}
        text = json.dumps(footer).encode()
        self.out.write(text + len(text).to_bytes(4, "little") + MAGIC)
        return len(ends), int(ends[-1]) if len(ends) else 0


class Shard:
    """Random access to the documents of one file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = file.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError("not a token file")
        n = int.from_bytes(tail[:4], "little")
        self.footer = json.loads(file.read_at(n, size - 12 - n))
        self.dtype = np.dtype(f"<u{self.footer['width']}")
        self.ends, self.doc_ids = (
            EliasFano(s["n"], s["low_bits"], *(file.read_at(length, at) for at, length in s["parts"]))
            for s in (self.footer["ends"], self.footer["doc_ids"]))

    def __len__(self) -> int:
        return self.ends.n

    def ids(self, i: int) -> np.ndarray:
        start = self.ends.select(i - 1) if i else 0
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((self.ends.select(i) - start) * width, start * width), self.dtype)

    def documents(self, start: int, stop: int) -> list[int | None]:
        nulls = self.footer["nulls"]
        known = self.doc_ids.slice(max(0, start - nulls), max(0, stop - nulls))
        known = (known + np.uint64(self.footer["base"] % (1 << 64))).astype(np.int64).tolist()
        return [None] * max(0, min(stop, nulls) - start) + known


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    part, enc, writer, uri = TaskContext.get().partitionId(), encoder(tokenizer), None, None
    uri = f"{folder}/shard-{part:06d}.tok"
    batches = (b for b in batches if b.num_rows)
    first = next(batches, None)
    if first is None:
        return
    with open_output(uri) as out:
        writer = ShardWriter(out, enc.dtype)
        for batch in (b for group in ([first], batches) for b in group):
            ids, at = batch.column("doc_id").to_pylist(), 0
            for flat, ends in enc.encode(batch.column("text")):
                flat = np.insert(flat, ends, end_id)  # after each document's last id
                writer.add(ids[at:at + len(ends)], flat, np.diff(ends, prepend=0) + 1)
                at += len(ends)
        n_docs, n_ids = writer.close()
    yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int32()), "uri": [uri],
                                      "n_docs": [n_docs], "n_ids": [n_ids]})


def write_token_files(docs: DataFrame, *, folder: str | None = None, tokenizer: str = DEFAULT_TOKENIZER,
                      end_id: int = 1, docs_per_shard: int = 20_000, bytes_per_shard: int = 128 << 20) -> DataFrame:
    """Encode ``docs`` (doc_id, text; other columns are ignored) in ascending doc_id order and write the
    shards; returns their manifest: shard, uri, n_docs, n_ids.

    Documents are range-sorted by (doc_id, digest of the text, text), so rows that share an id keep a
    fixed order and do not have to lie in one shard. Null ids come first; null text is empty (its
    document holds the end id alone); repeated rows are documents of their own; an empty table
    writes no shard. A shard's name is its place in the order, and it appears when it is whole, so a
    repeated task writes the same file again. There are so many shards that they hold ``docs_per_shard``
    documents and ``bytes_per_shard`` of text on the average, at most."""
    spark = docs.sparkSession
    folder = folder or run_folder(spark, "token-files")
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    shards = max(1, -(-n // docs_per_shard), -(-size // bytes_per_shard))
    order = ["doc_id", F.xxhash64("text"), "text"]
    ranged = rows.repartitionByRange(shards, *order[:2]).sortWithinPartitions(*order)
    return materialize(ranged.mapInArrow(lambda b: _write(b, folder, tokenizer, end_id), MANIFEST),
                       f"{folder}/manifest")


def _read(batches: Iterator[pa.RecordBatch], block_ids: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, first in zip(batch.column("uri").to_pylist(), batch.column("first").to_pylist(), strict=True):
            with open_input(uri) as file:
                shard = Shard(file)
                i, start, width = 0, 0, shard.dtype.itemsize
                while i < len(shard):
                    ends = shard.ends.slice(i, i + 8192).astype(np.int64)
                    ends = ends[:max(1, int(np.searchsorted(ends, start + block_ids, "right")))]
                    raw = file.read_at((int(ends[-1]) - start) * width, start * width)
                    ids = np.frombuffer(raw, shard.dtype).astype("<u4")
                    cuts = [start, *ends.tolist()]
                    crcs = [zlib.crc32(ids[a - start:b - start].data) for a, b in zip(cuts, cuts[1:], strict=False)]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(shard.documents(i, i + len(ends)), pa.int64()),
                        "start": pa.array([first + a for a in cuts[:-1]], pa.int64()),
                        "n_tokens": pa.array(np.diff(cuts), pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})
                    i, start = i + len(ends), int(ends[-1])


def read_token_files(manifest: DataFrame, *, block_ids: int = 2_000_000) -> DataFrame:
    """Per document of the files, from the files alone: doc_id, start (ids of all documents before it),
    n_tokens (with the end id), ids_crc32 (of its ids as little-endian unsigned 32-bit numbers)."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    shards = manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    n = max(1, manifest.count())
    return (shards.select("shard", "uri", "first").repartitionByRange(n, "shard")
            .mapInArrow(lambda b: _read(b, block_ids), "doc_id long, start long, n_tokens long, ids_crc32 long"))


def document_ids(spark: SparkSession, uri: str, i: int) -> np.ndarray:
    """The ids of document ``i`` of one shard."""
    with open_input(uri) as file:
        return Shard(file).ids(i)
