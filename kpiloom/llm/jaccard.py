"""Documents joined by the Jaccard similarity of their word n-grams, as a blocked sparse matrix product.

The matrix has a row for each distinct set of n-grams (copies share one) and a column for each n-gram, known by a
64-bit hash. Links are the pairs of rows whose product, the overlap, is large enough for their sizes.

Size-derived bounds keep nearly all of the product from being formed. Linked rows of x and y entries differ in at
most (100 - s)(x + y) div (100 + s) entries, s being the similarity in percent. Columns are dealt to blocks by
ranges of the hash, some 2 to 4 entries a block (one, for small sets). If D is the most that a row may differ
from any partner, then among its first D + 1 non-empty blocks one is equal in both rows. So a row is known by
the digests of so many blocks, and only rows that share a digest are multiplied; n-grams that many documents
have bring no rows together unless a whole block is equal.

For a pair that meets, the incidence folded to some bits a set, as parities, gives a lower bound of the differing
entries; pairs above D go. For the rest the overlap is accumulated column block by column block, and a pair is
discarded when its count and what is left of the smaller row stay below the bound.

Only components are wanted, so pairs within a component need no product. Digests that many rows share (near
copies by the thousand) are first resolved by comparing all rows with a few central ones; then rows outside the
digest's largest component are compared with all rows, in blocks of bounded size. No link is left out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.components import components
from kpiloom.llm.shared import materialize, run_folder
from kpiloom.llm.tokens import blocks
from kpiloom.llm.words import SPACES, coded_words

SHINGLE_WORDS = 4
PERCENT = 85
#: Sets below this size have single n-grams as column blocks.
SMALL_SET = 32
#: Digests of at most so many rows give all their pairs.
PAIR_ROWS = 64
#: Rows on either side of a block of the product.
BLOCK_ROWS = 2048
CENTRES = 3
FILTER_BITS = 1 << 26
_GOLDEN, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit numbers."""
    x = x + _GOLDEN
    x = (x ^ x >> np.uint64(30)) * _M1
    x = (x ^ x >> np.uint64(27)) * _M2
    return x ^ x >> np.uint64(31)


def allowed(x: int, y: int, percent: int) -> int:
    """Entries that linked sets of x and y entries may differ in, at most."""
    return (100 - percent) * (x + y) // (100 + percent)


def shingle_sets(texts: pa.Array, words_each: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct runs of ``words_each`` words (fewer words: of the whole sequence)."""
    text, code, words = coded_words(texts, SPACES)
    word = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))[code]
    counts = np.bincount(text, minlength=len(texts))
    starts = np.cumsum(counts) - counts

    def hashes(at: np.ndarray, length: int) -> np.ndarray:
        out = np.full(len(at), length, np.uint64)
        for k in range(length):
            out = mix(out ^ word[at + k])
        return out

    whole = np.flatnonzero(text[:max(0, len(text) - words_each + 1)] == text[words_each - 1:])
    run = hashes(whole, words_each)
    ends = np.searchsorted(whole, np.append(starts, len(text)))
    out = [np.unique(run[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    for length in range(1, words_each):
        few = np.flatnonzero(counts == length)
        for i, h in zip(few.tolist(), hashes(starts[few], length), strict=True):
            out[i] = np.array([h], np.uint64)
    return out


def row_id(hashes: np.ndarray) -> int:
    """Of a set, signed; equal sets have equal ids."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).astype(np.int64))


def _level(n: int) -> int:
    return (n // SMALL_SET).bit_length()


def digests(hashes: np.ndarray, percent: int) -> np.ndarray:
    """Digests of the column blocks by which a set meets every other set that it may be linked with.

    Block widths go by levels of the size, twice as many blocks each; a set also takes the level of its largest
    partner. A set with too few non-empty blocks takes all and then finer ones: of two linked sets either one has
    enough, or both take the finer blocks."""
    n = len(hashes)
    largest = n * 100 // percent
    needed = allowed(n, largest, percent) + 1
    if needed == 1:  # linked with equal sets only
        return np.zeros(0, np.uint64)
    out = []
    for level in range(_level(n), _level(largest) + 1):
        bits = 64 if level == 0 else min(64, SMALL_SET.bit_length() + level - 3)
        while True:
            block = hashes >> np.uint64(64 - bits)
            starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            enough = len(starts) >= needed
            digest = np.add.reduceat(mix(hashes), starts)[:needed]
            if enough and len(starts) > needed:  # the last block ends where the next begins
                digest = np.add.reduceat(mix(hashes[:starts[needed]]), starts[:needed])
            out.append(mix(digest ^ mix(np.array([1000 * level + bits], np.uint64))))
            if enough or bits == 64:
                break
            bits = min(64, bits + 2)
    return np.concatenate(out)


def parities(hashes: np.ndarray) -> bytes:
    """The incidence folded to a power of two of bits, at least the size: little-endian, as parities."""
    bits = max(64, 1 << (len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _differing(a: bytes, b: bytes) -> int:
    """A lower bound of the entries that two sets differ in, from their parities."""
    x, y, bits = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * max(len(a), len(b))
    if len(a) < len(b):
        x, y, a, b = y, x, b, a
    while bits > 8 * len(b):
        bits //= 2
        x = (x ^ x >> bits) & ((1 << bits) - 1)
    return (x ^ y).bit_count()


def overlaps(x: np.ndarray, y: np.ndarray, percent: int, column_blocks: int = 4) -> bool:
    """Whether the overlap of two rows, accumulated column block by column block, reaches what their sizes ask for."""
    needed = -(-percent * (len(x) + len(y)) // (100 + percent))
    edges = np.array([(k << 64) // column_blocks for k in range(1, column_blocks)], np.uint64)
    cut_x, cut_y = (np.concatenate(([0], np.searchsorted(v, edges), [len(v)])).tolist() for v in (x, y))
    count = 0
    for k in range(column_blocks):
        if count + min(len(x) - cut_x[k], len(y) - cut_y[k]) < needed:
            return False
        both = np.concatenate((x[cut_x[k]:cut_x[k + 1]], y[cut_y[k]:cut_y[k + 1]]))
        both.sort(kind="stable")
        count += int((both[1:] == both[:-1]).sum())
    return count >= needed


def _mark(batches: Iterator[pa.RecordBatch], words_each: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Size and row of each document; digests once for each row that a task meets."""
    seen: set[int] = set()
    for batch in batches:
        start = 0
        for block in blocks(batch.column("text")):
            rows, sizes, keys = [], [], []
            for h in shingle_sets(block, words_each):
                row = row_id(h) if len(h) else None
                new = row is not None and row not in seen
                rows.append(row)
                sizes.append(len(h))
                keys.append(digests(h, percent).view(np.int64) if new else np.zeros(0, np.int64))
                seen.add(row)
            ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(start, len(block)), pa.array(sizes, pa.int64()), pa.array(rows, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))], names=["doc_id", "n", "row", "keys"])
            start += len(block)


def _meet(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, row), and may repeat. Keys of 2 to ``most`` rows give their pairs (a, b); larger keys give
    their members (key, a). At most ``most`` rows are held from one batch to the next."""
    held = np.zeros((2, 0), np.int64)  # rows of the last key
    hot: int | None = None  # the last key, if its rows are given as members

    def out(keys: np.ndarray, rows: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, hot
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
        sizes = np.diff(np.append(starts, len(keys)))
        large = sizes > most
        if len(starts) and hot is not None and keys[0] == hot:
            large[0] = True
        hot = int(keys[-1]) if len(starts) and large[-1] else None
        size = np.repeat(np.where(large, 0, sizes), sizes)
        place = np.arange(len(keys)) - np.repeat(starts, sizes)
        if not last and len(starts) and not large[-1]:  # the last key may go on
            size[starts[-1]:] = 0
            held = np.stack((keys[starts[-1]:], rows[starts[-1]:]))
        else:
            held = np.zeros((2, 0), np.int64)
        first, second = [], []
        for step in range(1, int(size.max(initial=0))):
            at = np.flatnonzero(place + step < size)
            first.append(rows[at])
            second.append(rows[at + step])
        if first:
            pairs = np.unique(np.stack((np.concatenate(first), np.concatenate(second))), axis=1)
            yield pa.RecordBatch.from_arrays([pa.nulls(pairs.shape[1], pa.int64()), pa.array(pairs[0]), pa.array(pairs[1])],
                                             names=["key", "a", "b"])
        member = np.repeat(large, sizes)
        if member.any():
            yield pa.RecordBatch.from_arrays([pa.array(keys[member]), pa.array(rows[member]), pa.nulls(int(member.sum()), pa.int64())],
                                             names=["key", "a", "b"])

    before = None
    for batch in batches:
        now = np.stack((batch.column("key").to_numpy(), batch.column("row").to_numpy()))
        if not now.shape[1]:
            continue
        new = np.concatenate(([before is None or tuple(now[:, 0]) != before], (now[:, 1:] != now[:, :-1]).any(axis=0)))
        before = tuple(now[:, -1])
        now = np.concatenate((held, now[:, new]), axis=1)
        if now.shape[1]:
            yield from out(now[0], now[1], False)
    yield from out(held[0], held[1], True)


def _row_filter(rows: DataFrame) -> bytes:
    """One bit for each value of the low bits of the rows' ids; its size does not depend on the rows."""
    at = F.pmod("a", F.lit(FILTER_BITS))
    found = (rows.groupBy(F.expr("pmod(a, %d) div 32768" % FILTER_BITS).alias("part"))
             .agg(F.bitmap_construct_agg(at % 32768).alias("bits")).toArrow())
    out = bytearray(FILTER_BITS // 8)
    for part, bits in zip(found["part"].to_pylist(), found["bits"].to_pylist(), strict=True):
        out[part * 4096:(part + 1) * 4096] = bits
    return bytes(out)


def _sets(batches: Iterator[pa.RecordBatch], words_each: int, wanted: bytes) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        for block in blocks(batch.column("text")):
            rows = []
            for h in shingle_sets(block, words_each):
                if len(h) and (row := row_id(h)) not in seen:
                    at = row % FILTER_BITS
                    if wanted[at >> 3] >> (at & 7) & 1:
                        seen.add(row)
                        rows.append((row, len(h), parities(h), h.astype("<u8").tobytes()))
            if rows:
                row, n, bits, h = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(n, pa.int64()), pa.array(bits), pa.array(h)],
                                                 names=["row", "n", "bits", "hashes"])


def _possible(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("na", "nb", "bits_a", "bits_b"))
        keep = [_differing(p, q) <= allowed(x, y, percent) for x, y, p, q in zip(*columns, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        each = zip(batch.column("hashes_a"), batch.column("hashes_b"), strict=True)
        keep = [overlaps(np.frombuffer(p.as_buffer(), "<u8"), np.frombuffer(q.as_buffer(), "<u8"), percent) for p, q in each]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _cross(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; in each, the outer rows are compared with the others of other components."""
    names = ("outer", "row", "n", "label", "bits")
    held: list[list] = [[] for _ in names]
    block = None

    def compare() -> Iterator[pa.RecordBatch]:
        outer, row, n, label = (np.array(x) for x in held[:4])
        if not outer.any() or outer.all():
            return
        words = min(len(b) for b in held[4]) // 8
        folded = np.array([functools.reduce(np.bitwise_xor, np.frombuffer(b, "<u8").reshape(-1, words)) for b in held[4]])
        inner = np.flatnonzero(~outer)
        first, second = [], []
        for i in np.flatnonzero(outer).tolist():
            differing = np.bitwise_count(folded[inner] ^ folded[i]).sum(axis=1, dtype=np.int64)
            near = inner[(label[inner] != label[i]) & (differing <= (100 - percent) * (n[inner] + n[i]) // (100 + percent))]
            first.append(np.minimum(row[near], row[i]))
            second.append(np.maximum(row[near], row[i]))
        pairs = np.unique(np.stack((np.concatenate(first), np.concatenate(second))), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    for batch in batches:
        for values in zip(*(batch.column(c).to_pylist() for c in ("block", *names)), strict=True):
            if values[0] != block:
                yield from compare() if block is not None else ()
                held, block = [[] for _ in names], values[0]
            for column, value in zip(held, values[1:], strict=True):
                column.append(value)
    if block is not None:
        yield from compare()


class Product:
    """The links among the rows of one call: verified pairs of rows, and what is known of components."""

    def __init__(self, sets: DataFrame, folder: str, percent: int):
        self.sets, self.folder, self.percent, self.links, self.step = sets, folder, percent, None, 0

    def add(self, pairs: DataFrame) -> int:
        """Verify distinct pairs (a, b); the number of links among them."""
        self.step += 1
        at, percent = f"{self.folder}/{self.step}", self.percent
        for side in ("a", "b"):
            narrow = self.sets.select(F.col("row").alias(side), F.col("n").alias(f"n{side}"), F.col("bits").alias(f"bits_{side}"))
            pairs = pairs.join(narrow, side)
        in_size = f"least(na, nb) * 100 >= greatest(na, nb) * {percent}"
        pairs = materialize(pairs.filter(in_size).mapInArrow(lambda b: _possible(b, percent), "a long, b long"), f"{at}-possible")
        for side in ("a", "b"):
            pairs = pairs.join(self.sets.select(F.col("row").alias(side), F.col("hashes").alias(f"hashes_{side}")), side)
        found = materialize(pairs.mapInArrow(lambda b: _linked(b, percent), "a long, b long"), f"{at}-links")
        self.links = found if self.links is None else self.links.union(found)
        return found.count()

    def labels(self) -> DataFrame:
        """(row, label): the components of the links so far, without rows that have none."""
        found = components(self.links.select(F.col("a").alias("u"), F.col("b").alias("v")), f"{self.folder}/{self.step}-components")
        return materialize(found.select(F.col("node").alias("row"), F.col("root").alias("label")), f"{self.folder}/{self.step}-labels")


def _star(members: DataFrame, centres: int) -> DataFrame:
    """Pairs (a, b) of the members (key, row) of each key with a few of its rows: the one that meets most others, and
    others by a hash, so that keys of the same rows choose the same."""
    sized = members.join(members.groupBy("key").agg(F.count("*").alias("size")), "key")
    met = sized.groupBy("row").agg(F.sum("size").alias("met"))
    orders = [F.struct("met", "row"), *(F.xxhash64("row", F.lit(i)) for i in range(1, centres))]
    chosen = members.join(met, "row").groupBy("key").agg(*(F.max_by("row", x).alias(f"c{i}") for i, x in enumerate(orders)))
    centre = F.explode(F.array_distinct(F.array(*(f"c{i}" for i in range(centres)))))
    return members.join(chosen.select("key", centre.alias("centre")), "key").filter("row <> centre").select(
        F.least("row", "centre").alias("a"), F.greatest("row", "centre").alias("b"))


def _rest(product: Product, members: DataFrame, labels: DataFrame, block_rows: int) -> DataFrame:
    """Pairs (a, b) of rows outside the largest component of a key and all rows of other components there that may be
    linked."""
    percent = product.percent
    rows = members.join(labels, "row", "left").select("key", "row", F.coalesce("label", "row").alias("label"))
    mixed = rows.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("size"))
    rows = materialize(rows.join(mixed.filter("x < y").select("key", "size"), "key"), f"{product.folder}/rest")
    counts = rows.groupBy("key", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"),
                                     (F.sum("n") - F.max("n")).alias("others"))
    parts = lambda n: F.ceil(F.col(n) / block_rows).cast("int")
    rows = rows.join(main, "key").join(product.sets.select("row", "n", "bits"), "row").select(
        "key", "row", "n", "label", "bits", (F.col("label") != F.col("main")).alias("out"),
        parts("size").alias("inner_parts"), parts("others").alias("outer_parts"))
    part = lambda n: F.pmod(F.xxhash64("row", F.lit(7)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = rows.filter("out").withColumn("i", part("outer_parts")).withColumn("j", each("inner_parts"))
    inner = rows.withColumn("i", each("outer_parts")).withColumn("j", part("inner_parts"))
    both = outer.withColumn("outer", F.lit(True)).union(inner.withColumn("outer", F.lit(False))).select(
        F.xxhash64("key", "i", "j").alias("block"), "outer", "row", "n", "label", "bits")
    return both.repartition("block").sortWithinPartitions("block").mapInArrow(
        lambda b: _cross(b, percent), "a long, b long").distinct()


def jaccard_groups(docs: DataFrame, *, words_each: int = SHINGLE_WORDS, percent: int = PERCENT, pair_rows: int = PAIR_ROWS,
                   block_rows: int = BLOCK_ROWS, centres: int = CENTRES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_shingles (the size of the set of
    ``words_each``-word shingles; fewer words: the whole sequence is one), component_id (the smallest doc_id that links
    reach, itself included). Sets link if their Jaccard similarity is at least ``percent`` in a hundred.

    Null texts and texts without words have an empty set and no links. A null doc_id gets its component's smallest
    id; a component without any id has null. Repeated rows are kept, and copies are linked. An empty table gives
    no rows. Sets and shingles are told apart by 64-bit hashes.

    ``pair_rows``, ``block_rows`` and ``centres`` set how much is compared at once, not what is found."""
    folder = run_folder(docs.sparkSession, "jaccard")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")
    marked = materialize(texts.mapInArrow(lambda b: _mark(b, words_each, percent),
                                          f"doc_id {id_type}, n long, row long, keys array<long>"), f"{folder}/rows")
    met = materialize(marked.select(F.explode("keys").alias("key"), "row").repartition("key").sortWithinPartitions("key", "row")
                      .mapInArrow(lambda b: _meet(b, pair_rows), "key long, a long, b long"), f"{folder}/met")
    members = met.filter("key is not null").select("key", F.col("a").alias("row"))
    pairs = met.filter("key is null").select("a", "b")

    wanted = docs.sparkSession.sparkContext.broadcast(  # of fixed size
        _row_filter(
        met.select("a").union(pairs.select("b"))))
    sets = materialize(texts.select("text").mapInArrow(
        lambda b: _sets(b, words_each, wanted.value), "row long, n long, bits binary, hashes binary").dropDuplicates(["row"]),
        f"{folder}/sets")
    product = Product(sets, f"{folder}/product", percent)
    large = not members.isEmpty()
    if large:
        pairs = pairs.union(_star(members, centres))
    product.add(pairs.distinct())
    labels = product.labels()
    if large and product.add(_rest(product, members, labels, block_rows)):
        labels = product.labels()

    first = marked.filter("row is not null").groupBy("row").agg(F.min("doc_id").alias("first"))
    rooted = materialize(first.join(labels, "row", "left").select("row", "first", F.coalesce("label", "row").alias("label")),
                         f"{folder}/rooted")
    ids = rooted.groupBy("label").agg(F.min("first").alias("component_id"))
    of = materialize(rooted.join(ids, "label").select("row", "component_id"), f"{folder}/components")
    # empty sets have no row
    return marked.join(of, "row", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("row").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
