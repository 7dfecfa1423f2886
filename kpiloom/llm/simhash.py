"""SimHash near-duplicates by anchor-point covering.

The 64 bits of a fingerprint are three blocks. Two fingerprints with at most 4 differing bits differ
in at most 1 bit of some block. A block, filled up with zeros to 23 bits, is covered by the perfect
binary Golay code: every value lies within 3 bits (the covering radius) of exactly one of its 4096
words, its home anchor. A fingerprint goes to its home and to every anchor within radius plus
threshold (3 + 1 bits, about 5 of 4096); two that are linked meet at the home of either, where whole
fingerprints are compared. So nothing within the distance is missed and nothing beyond it is linked.

Anchors with more homes than a task should compare give their fingerprints to a finer cover: the
whole 64-bit space with radius 0, where two fingerprints within 4 bits share a point within 2 bits
of each. That costs 2081 points a fingerprint, whatever the size of the group.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.llm.components import components
from kpiloom.llm.shared import materialize, row_digest, run_folder

#: The contract's seed, shingle length and distance; block widths; the generator
#: polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the binary Golay code of length 23.
SEED = 42
SHINGLE_WORDS = 4
MAX_BITS = 4
BLOCKS = (22, 21, 21)
GOLAY_POLYNOMIAL = 0b110001110101
RADIUS = 3


def fingerprints(texts: list[bytes], words_each: int = SHINGLE_WORDS) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text (UTF-8): A-Z lower-cased, words as bytes.split() gives them,
    shingles of ``words_each`` words joined by a blank (fewer words: one shingle of all; none: 0)."""
    out = np.zeros(len(texts), np.uint64)
    digest = functools.partial(xxhash.xxh64_intdigest, seed=SEED)
    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        n = max(1, len(words) - words_each + 1)
        counts = np.zeros(64, np.int64)
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        last = ends[min(words_each, len(words)) - 1:]
        for at in range(0, n, 1 << 15):
            hashes = np.fromiter(map(digest, [joined[a:b] for a, b in zip(
                starts[at:min(n, at + (1 << 15))].tolist(), last[at:at + (1 << 15)].tolist(), strict=True)]), np.uint64)
            bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        set_bits = (2 * counts > n).astype(np.uint8)
        out[i] = np.packbits(set_bits, bitorder="little").view("<u8")[0]
    return out


@functools.cache
def _cosets(reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each syndrome, the patterns of at most ``reach`` bits that lead from a value with it to a code
    word: their starts, counts and the patterns (lightest first). And the syndromes of the byte values
    of a 23-bit number."""
    units = []
    for bit in range(23):  # the remainder of x^bit
        r = 1 << bit
        for shift in range(22, 10, -1):
            if r >> shift & 1:
                r ^= GOLAY_POLYNOMIAL << (shift - 11)
        units.append(r)
    tables = np.array([[functools.reduce(int.__xor__, (units[8 * k + j] for j in range(8)
                                                       if v >> j & 1 and 8 * k + j < 23), 0)
                        for v in range(256)] for k in range(3)], np.int32)
    patterns = [sum(1 << b for b in c) for w in range(reach + 1) for c in itertools.combinations(range(23), w)]
    patterns = np.array(patterns, np.int64)
    of = tables[0][patterns & 255] ^ tables[1][patterns >> 8 & 255] ^ tables[2][patterns >> 16]
    order = np.argsort(of, kind="stable")
    counts = np.bincount(of, minlength=2048)
    return np.concatenate(([0], np.cumsum(counts)[:-1])), counts, patterns[order], tables


def anchors(values: np.ndarray, reach: int = RADIUS + 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For 23-bit values: (row, anchor, is_home) for every code word within ``reach`` bits."""
    starts, counts, patterns, t = _cosets(reach)
    values = values.astype(np.int64)
    syndrome = t[0][values & 255] ^ t[1][values >> 8 & 255] ^ t[2][values >> 16]
    n = counts[syndrome]
    row = np.repeat(np.arange(len(values)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    pattern = patterns[starts[syndrome][row] + nth]
    return row, values[row] ^ pattern, np.bitwise_count(pattern) <= RADIUS


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], words_each: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()
        rest = [name for name in batch.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays(
            [*map(batch.column, rest), pa.array(fingerprints(texts, words_each).view(np.int64))], names=[*rest, "fp"])


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, shift = batch.column("fp").to_numpy().view(np.uint64), 0
        for block, width in enumerate(BLOCKS):
            part = values >> np.uint64(shift) & np.uint64((1 << width) - 1)
            shift += width
            row, anchor, home = anchors(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array((anchor * len(BLOCKS) + block).astype(np.int32)), pa.array(values[row].view(np.int64)),
                 pa.array(home)], names=["anchor", "fp", "home"])


def link_groups(values: np.ndarray, home: np.ndarray, max_bits: int) -> np.ndarray:
    """Index of the first value of each value's group, where groups are joined by links between a home and
    any value. Linear memory: no pair is written."""
    label = np.arange(len(values))
    for i in np.flatnonzero(home):
        near = label[np.bitwise_count(values ^ values[i]) <= max_bits]
        low = near.min()
        if near.max() != low:
            label[np.isin(label, near)] = low
    return label


def _compare(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (anchor, chunk); a group is compared when its last row is there."""
    held: list[pa.RecordBatch] = []

    def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key = table["key"].to_numpy()
        values, home = table["fp"].to_numpy().view(np.uint64), table["home"].to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        us, vs = [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                label = link_groups(values[a:b], home[a:b], max_bits)
                moved = np.flatnonzero(label != np.arange(b - a))
                us.append(values[a:b][moved])
                vs.append(values[a:b][label[moved]])
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us).view(np.int64)),
                                              pa.array(np.concatenate(vs).view(np.int64))], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        if held and key[0] != held[-1].column("key")[-1].as_py():
            yield from links(pa.Table.from_batches(held))
            held = []
        cut = int(np.searchsorted(key, key[-1], "left"))  # the last group may go on in the next batch
        if cut:
            yield from links(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from links(pa.Table.from_batches(held))


def _midpoints(batches: Iterator[pa.RecordBatch], half: int) -> Iterator[pa.RecordBatch]:
    bits = [np.uint64(1 << b) for b in range(64)]
    masks = np.array([functools.reduce(np.bitwise_xor, c, np.uint64(0)) for w in range(half + 1)
                      for c in itertools.combinations(bits, w)], np.uint64)
    for batch in batches:
        values = batch.column("fp").to_numpy().view(np.uint64)
        for i in range(0, len(values), 64):
            part = values[i:i + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array((part[:, None] ^ masks).ravel().view(np.int64)),
                 pa.array(np.repeat(part, len(masks)).view(np.int64))], names=["point", "fp"])


def linked(distinct: DataFrame, folder: str, *, most_homes: int = 20_000, chunk: int = 60_000) -> DataFrame:
    """(fp) distinct -> edges (u, v) whose components are those of all links of at most ``MAX_BITS`` bits.

    ``most_homes``: anchors with more homes go to the finer cover. ``chunk``: the other values of an anchor are
    dealt out in parts of about so many, each with all homes, so one comparison holds a bounded number."""
    replicas = materialize(distinct.mapInArrow(_replicate, "anchor int, fp long, home boolean"), f"{folder}/anchors")
    sizes = replicas.groupBy("anchor").agg(F.count("*").alias("n"), F.count(F.when(F.col("home"), 1)).alias("homes"))
    sizes = materialize(sizes, f"{folder}/sizes")  # 3 x 4096 anchors at most, so it may be broadcast
    cool = sizes.filter((F.col("homes") <= most_homes) & (F.col("homes") > 0) & (F.col("n") > 1))
    parts = F.ceil(F.col("n") / chunk).cast("int")
    rows = replicas.join(F.broadcast(cool.select("anchor", parts.alias("parts"))), "anchor")
    rows = rows.withColumn("part", F.explode(F.when(F.col("home"), F.sequence(F.lit(0), F.col("parts") - 1))
                                             .otherwise(F.array(F.pmod(F.xxhash64("fp"), "parts").cast("int")))))
    rows = rows.select(F.xxhash64("anchor", "part").alias("key"), "fp", "home")
    edges = rows.repartition("key").sortWithinPartitions("key", F.col("home").desc(), "fp").mapInArrow(
        lambda b: _compare(b, MAX_BITS), "u long, v long")
    if (hot := sizes.filter(F.col("homes") > most_homes)).isEmpty():
        return edges
    points = (replicas.join(F.broadcast(hot.select("anchor")), "anchor").select("fp").distinct()
              .mapInArrow(lambda b: _midpoints(b, MAX_BITS // 2), "point long, fp long"))
    near = points.groupBy("point").agg(F.min("fp").alias("v"), F.max("fp").alias("top"), F.collect_list("fp").alias("us"))
    # a point has at most 2081 fingerprints around it
    return edges.union(near.filter("v <> top").select(F.explode("us").alias("u"), "v").filter("u <> v"))


def _marked(docs: DataFrame, folder: str, words_each: int) -> DataFrame:
    """The columns of ``docs`` but the text, and fp; written once."""
    rest = docs.drop("text")
    return materialize(docs.mapInArrow(lambda b: _fingerprint_batches(b, words_each), T.StructType(
        [*rest.schema.fields, T.StructField("fp", T.LongType())])), f"{folder}/fingerprints")


def _rooted(points: DataFrame, folder: str, most_homes: int) -> DataFrame:
    """``points`` (fp, distinct, and other columns) with the fingerprint that stands for the group."""
    roots = components(linked(points.select("fp"), folder, most_homes=most_homes), f"{folder}/components")
    return points.join(roots, points["fp"] == roots["node"], "left").select(
        *points.columns, F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, *, words_each: int = SHINGLE_WORDS, most_homes: int = 20_000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, fingerprint (16 hex
    digits), component_id (the smallest doc_id that links reach, itself included).

    Copies share a fingerprint and are one point until the last join. Null and empty texts have
    fingerprint zero and are linked like any other. A null doc_id gets its group's smallest id; a
    group without any id has null. Repeated rows are kept; an empty table gives no rows."""
    folder = run_folder(docs.sparkSession, "simhash")
    marked = _marked(docs.select("doc_id", "text"), folder, words_each)
    points = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), f"{folder}/points")
    grouped = _rooted(points, folder, most_homes)
    ids = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    of = materialize(grouped.join(ids, "root").select("fp", "component_id"), f"{folder}/groups")
    return marked.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                        "component_id")


def keep_one(docs: DataFrame, *, words_each: int = SHINGLE_WORDS, most_homes: int = 20_000) -> DataFrame:
    """One row of each group of ``docs``, whatever their ids: that of the smallest doc_id (null: after all
    others), of these that of the smallest digest of the text (null: first), and then of the whole row.

    Groups are those of fingerprints, so rows that share an id but no links each have their group, and rows
    without an id are copies of each other or not like any others."""
    folder = run_folder(docs.sparkSession, "simhash")
    marked = _marked(docs.select("doc_id", "text", F.sha2("text", 256).alias("digest"), row_digest(docs).alias("row")),
                     folder, words_each)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", "row")
    points = materialize(marked.groupBy("fp").agg(F.min(order).alias("first")), f"{folder}/points")
    lead = _rooted(points, folder, most_homes).groupBy("root").agg(F.min("first").alias("first")).select("first.row")
    lead = materialize(lead, f"{folder}/lead")
    # repeated rows are equal, so any of them will do; one row leads one group at most
    return (docs.withColumn("_row", row_digest(docs)).join(lead, F.col("_row") == lead["row"], "left_semi")
            .dropDuplicates(["_row"]).drop("_row"))
