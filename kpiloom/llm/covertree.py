"""Exact top-k inner products by dual-tree search over cover trees.

Vectors become integers, are gathered into blocks of bounded size with their neighbours (by the nearest
of a few centres from a bounded sample), and each block is indexed by a cover tree: a node has a
centre and a covering radius, and its children's centres are far apart. Queries are grouped and
indexed the same way. For a query node and a data node, with centres p and q and radii r and s, no
inner product is above  p.q + |p| s + |q| r + r s ; a pair of nodes below the worst kth score of its
query group is pruned. The kth scores start from the sample, so they are never above the true ones.

Data blocks are dealt to shards; each query group visits each shard, not each block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kpiloom.llm.shared import materialize, run_folder

SAMPLE_ROWS = 2048
CENTRES = 64
BLOCK_ROWS = 2048
GROUP_QUERIES = 256
SHARD_BLOCKS = 8
DATA_LEAF, QUERY_LEAF, FAN_OUT = 128, 64, 8
_EXACT = float(1 << 52)


@dataclass
class Node:
    """Rows ``start`` to ``stop`` of the ordered block lie within ``radius`` of ``centre``."""

    start: int
    stop: int
    centre: np.ndarray
    norm: float
    radius: float
    children: list[Node]


def spread(points: np.ndarray, most: int, within: float = 0.0) -> tuple[list[int], np.ndarray]:
    """Rows picked by farthest-point order until ``most`` are there or all others lie ``within`` reach; and the
    nearest picked row of each row (as its place in the list)."""
    picked, owner = [0], np.zeros(len(points), np.int64)
    far = np.linalg.norm(points - points[0], axis=1)
    while len(picked) < most:
        i = int(far.argmax())
        if far[i] <= within:
            break
        near = np.linalg.norm(points - points[i], axis=1)
        owner[near < far] = len(picked)
        far = np.minimum(far, near)
        picked.append(i)
    return picked, owner


def cover_tree(points: np.ndarray, leaf: int) -> tuple[np.ndarray, Node]:
    """(order, root): the rows in tree order, and the tree over that order. A node's children are centred at
    points more than half its radius apart (the ``FAN_OUT`` farthest of them); radii are those measured."""
    order = np.arange(len(points))

    def build(start: int, stop: int) -> Node:
        mine = points[order[start:stop]]
        centre = mine.mean(axis=0)
        radius = float(np.linalg.norm(mine - centre, axis=1).max())
        node = Node(start, stop, centre, float(np.linalg.norm(centre)), radius, [])
        if stop - start > leaf and radius > 0:
            picked, owner = spread(mine, FAN_OUT, radius / 2)
            if len(picked) > 1:
                order[start:stop] = order[start:stop][np.argsort(owner, kind="stable")]
                ends = start + np.cumsum(np.bincount(owner, minlength=len(picked)))
                node.children = [build(a, b) for a, b in zip([start, *ends[:-1].tolist()], ends.tolist(), strict=True) if b > a]
        return node

    root = build(0, len(points))
    return order, root


class Search:
    """Best ``k`` of all data shown to one group of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray):
        order, self.root = cover_tree(vectors.astype(np.float64), QUERY_LEAF)
        self.ids, self.vectors, self.k, self.floor = ids[order], vectors[order], k, floor[order]
        self.score = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.norms = np.linalg.norm(self.vectors.astype(np.float64), axis=1).max(initial=0.0)

    def worst(self, a: int, b: int) -> int:
        """The lowest score that still counts for some query of the rows."""
        return int(np.maximum(self.score[a:b, -1], self.floor[a:b]).min())

    def visit(self, ids: np.ndarray, vectors: np.ndarray, root: Node) -> None:
        # beyond 2^52 sums in doubles are not exact
        exact = self.norms * np.linalg.norm(vectors.astype(np.float64), axis=1).max(initial=0.0) < _EXACT
        kind = np.float64 if exact else np.int64
        queries, data = self.vectors.astype(kind), vectors.astype(kind)
        stack = [(self.root, root)]
        while stack:
            q, d = stack.pop()
            bound = float(q.centre @ d.centre) + q.norm * d.radius + d.norm * q.radius + q.radius * d.radius
            bound += 1.0 + 1e-9 * (q.norm + q.radius) * (d.norm + d.radius)  # rounding
            if bound < self.worst(q.start, q.stop):
                continue
            if d.children and (d.radius >= q.radius or not q.children):
                # the most promising child is popped first
                stack += sorted(((q, c) for c in d.children),
                                key=lambda x: float(x[0].centre @ x[1].centre) + x[0].norm * x[1].radius)
            elif q.children:
                stack += [(c, d) for c in q.children]
            else:
                self._compare(q, queries, ids[d.start:d.stop], data[d.start:d.stop])

    def _compare(self, q: Node, queries: np.ndarray, ids: np.ndarray, data: np.ndarray) -> None:
        rows = slice(q.start, q.stop)
        scores = (queries[rows] @ data.T).astype(np.int64)
        least = np.maximum(self.score[rows, -1], self.floor[rows])
        good = (scores >= least[:, None]) & (ids[None, :] != self.ids[rows][:, None])
        if not good.any():
            return
        some, which = np.flatnonzero(good.any(axis=1)), np.flatnonzero(good.any(axis=0))
        take = good[np.ix_(some, which)]
        lowest, last = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        score = np.concatenate((self.score[rows][some], np.where(take, scores[np.ix_(some, which)], lowest)), axis=1)
        found = np.concatenate((self.found[rows][some], np.where(take, ids[which][None, :], last)), axis=1)
        best = np.lexsort((found, -score.astype(np.float64) if abs(score[score > lowest]).max(initial=0) < _EXACT
                           else ~score), axis=1)[:, :self.k]
        self.score[some + q.start] = np.take_along_axis(score, best, axis=1)
        self.found[some + q.start] = np.take_along_axis(found, best, axis=1)


def quantised(vector: Column) -> Column:
    """floor(256 * x) of every component as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256.0).cast("long"))


def _rows(array: pa.Array, width: int) -> np.ndarray:
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(array), width)


def _assign(batches: Iterator[pa.RecordBatch], centres: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        widths = batch.column("v").value_lengths().to_numpy()
        cell = np.zeros(len(widths), np.int32)
        for width in np.unique(widths):
            at = np.flatnonzero(widths == width)
            if (c := centres.get(int(width))) is not None and len(c):
                v = _rows(batch.column("v").take(pa.array(at)), int(width)).astype(np.float64)
                cell[at] = ((c * c).sum(axis=1)[None, :] - 2 * v @ c.T).argmin(axis=1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(widths.astype(np.int32)), pa.array(cell)],
                                         names=["vec_id", "v", "width", "cell"])


def _bundle(table: pa.Table) -> pa.Table:
    """One row for a block: ids and vectors as bytes, ordered by id."""
    order = np.argsort(table["vec_id"].to_numpy(), kind="stable")
    width = table["width"][0].as_py()
    vectors = _rows(table["v"].combine_chunks(), width)[order]
    narrow = np.int16 if np.abs(vectors).max(initial=0) < 1 << 15 else np.int64
    return pa.table({"width": pa.array([width], pa.int32()), "wide": pa.array([np.dtype(narrow).itemsize], pa.int32()),
                     "ids": pa.array([table["vec_id"].to_numpy()[order].astype("<i8").tobytes()]),
                     "vectors": pa.array([vectors.astype(narrow).tobytes()])})


_BUNDLE = "width int, wide int, ids binary, vectors binary"


def blocks_of(rows: DataFrame, most: int) -> DataFrame:
    """Blocks of about ``most`` rows at most, each of one width and cell; large cells are dealt out by a hash."""
    sizes = rows.groupBy("width", "cell").agg(F.ceil(F.count("*") / most).alias("parts"))
    # a row for each width and centre
    dealt = rows.join(F.broadcast(sizes), ["width", "cell"]).withColumn(
        "part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    return dealt.groupBy("width", "cell", "part").applyInArrow(_bundle, _BUNDLE)


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8").astype(np.int64)
    vectors = np.frombuffer(row["vectors"], np.int16 if row["wide"] == 2 else np.int64)
    return ids, vectors.astype(np.int64).reshape(len(ids), row["width"])


def _sample_floor(ids: np.ndarray, vectors: np.ndarray, sample: tuple[np.ndarray, np.ndarray] | None, k: int) -> np.ndarray:
    """The kth best score of each query among the sampled rows: at most its kth best among all."""
    floor = np.full(len(ids), np.iinfo(np.int64).min)
    if sample is not None and len(sample[0]) > k:
        scores = np.where(ids[:, None] == sample[0][None, :], floor[0], vectors @ sample[1].T)
        floor = -np.partition(~scores, k - 1, axis=1)[:, k - 1] - 1
    return floor


def _search(batches: Iterator[pa.RecordBatch], samples: dict, k: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (shard, is_query): a shard's data blocks, then every query group."""
    shard, data = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["shard"] != shard:
                shard, data = row["shard"], []
            ids, vectors = _unpack(row)
            if not row["is_query"]:
                order, root = cover_tree(vectors.astype(np.float64), DATA_LEAF)
                data.append((ids[order], vectors[order], root))
                continue
            search = Search(ids, vectors, k, _sample_floor(ids, vectors, samples.get(row["width"]), k))
            middle = search.root.centre
            for block in sorted((b for b in data if b[1].shape[1] == row["width"]), key=lambda b: -float(middle @ b[2].centre)):
                search.visit(*block)
            at, rank = np.nonzero(search.found != np.iinfo(np.int64).max)
            yield pa.RecordBatch.from_arrays(
                [pa.array(search.ids[at]), pa.array(search.found[at, rank]), pa.array(search.score[at, rank])],
                names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, sample_rows: int = SAMPLE_ROWS,
          block_rows: int = BLOCK_ROWS, group_queries: int = GROUP_QUERIES,
          shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """``vectors`` (vec_id, embedding; other columns are ignored) -> query_id, rank (from 1), vec_id, score.

    Queries are the rows that ``is_query`` holds for; candidates are all rows with another id; equal scores go to
    the smaller id. Vectors that are null or hold a null or non-finite component take no part, nor do rows
    without an id. Rows repeated with equal vectors count once; vectors of other lengths than the query's are
    not its candidates. An empty table gives no rows.

    ``sample_rows`` bounds the rows that centres and first kth scores are taken from (those of smallest hash);
    every row is indexed and compared or pruned by a bound, so results are exact."""
    spark = vectors.sparkSession
    folder = run_folder(spark, "topk")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v")).dropDuplicates(["vec_id", "v"])
    rows = materialize(rows, f"{folder}/rows")
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow()
    samples, centres = {}, {}
    widths = picked["v"].combine_chunks().value_lengths().to_numpy() if len(picked) else np.zeros(0, int)
    for width in np.unique(widths).tolist():
        some = picked.filter(pa.array(widths == width))
        v = _rows(some["v"].combine_chunks(), width)
        samples[width] = (some["vec_id"].to_numpy(), v)
        centres[width] = v[spread(v.astype(np.float64), CENTRES)[0]].astype(np.float64)
    placed = materialize(rows.mapInArrow(lambda b: _assign(b, centres), "vec_id long, v array<long>, width int, cell int"),
                         f"{folder}/cells")
    n = placed.count()
    shards = max(1, math.ceil(n / (block_rows * shard_blocks)))
    data = blocks_of(placed, block_rows).withColumn("is_query", F.lit(False)).withColumn(
        "shard", F.pmod(F.xxhash64("ids"), F.lit(shards)).cast("int"))
    groups = blocks_of(placed.filter(is_query), group_queries).withColumn("is_query", F.lit(True)).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    shared = spark.sparkContext.broadcast(samples)
    found = (data.unionByName(groups).repartition("shard").sortWithinPartitions("shard", "is_query")
             .mapInArrow(lambda b: _search(b, shared.value, k), "query_id long, vec_id long, score long"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.dropDuplicates().withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
