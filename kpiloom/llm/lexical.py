"""Exact ranked lexical search over sparse ball trees.

A document is a sparse vector over the queries' terms: a term's weight times its saturated frequency, an
integer. A query is the 0/1 vector of its terms, so a score is an inner product and a sum of integers.
Documents are gathered into shards, and each shard is a ball tree. A node's centre is the mean of its
documents. One ball over all terms is loose, as most of a document's terms are not the query's; so the space is
the product of small ones, one for the terms that only one query has and one for each term that several have,
and a node has a radius in each: the largest distance from the centre there. No document of a node scores more than

    sum of the centre over the query's terms  +  sum over the spaces of sqrt(the query's terms there) * radius,

rounded up. Nodes are visited best bound first; a subtree whose bound is below the query's kth score so far is
pruned, and the documents of a leaf are scored in integers. Each task keeps k documents a query.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kpiloom.llm.shared import materialize, run_folder
from kpiloom.llm.tokens import blocks
from kpiloom.llm.words import NOT_LETTERS_OR_DIGITS, coded_words

TOP = 10
LENGTH_PERCENT = 90
LEAF_ROWS = 32
SHARD_ROWS = 4096
SHARD_ENTRIES = 1 << 20
BLOCK_TERMS = 50_000
#: Bounds the relative error of sums of up to 10^6 doubles.
ROUNDING = 1e-9


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, code, words = coded_words(batch.column("text"), NOT_LETTERS_OR_DIGITS)
        text, code = np.divmod(np.unique(text * max(1, len(words)) + code), max(1, len(words)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("query").take(pa.array(text)), pa.array(words, pa.binary()).take(pa.array(code))],
            names=["query", "term"])


def _vectors(batches: Iterator[pa.RecordBatch], places: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Each document's number of terms, and its terms among ``places`` with their frequencies."""
    for batch in batches:
        start = 0
        for block in blocks(batch.column("text")):
            text, code, words = coded_words(block, NOT_LETTERS_OR_DIGITS)
            place = np.fromiter((places.get(w, -1) for w in words), np.int64, len(words))[code]
            known = place >= 0
            entry, tf = np.unique(text[known] * max(1, len(places)) + place[known], return_counts=True)
            row, term = np.divmod(entry, max(1, len(places)))
            ends = pa.array(np.searchsorted(row, np.arange(len(block) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(start, len(block)), pa.array(np.bincount(text, minlength=len(block))),
                 pa.ListArray.from_arrays(ends, pa.array(term.astype(np.int32))),
                 pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))], names=["doc_id", "n", "terms", "tfs"])
            start += len(block)


def _holders(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    n = np.zeros(size, np.int64)
    for batch in batches:
        n += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
    hit = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(n[hit])], names=["term", "df"])


@dataclass
class Statistics:
    """Of all documents: those with a term, their terms, each term's weight."""

    n_docs: int
    n_terms: int
    weights: np.ndarray
    length_percent: int

    def entries(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        """The vectors' entries: weight * ((10^9 tf) div (1000 tf + 8 m)), with m from a document's length."""
        m = [100 - self.length_percent + self.length_percent * x * self.n_docs // self.n_terms for x in n.tolist()]
        tf = tfs.astype(np.int64)
        return self.weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(np.array(m, np.int64), sizes)))


@dataclass
class Shard:
    """Sparse rows: entries ``ends[i]`` to ``ends[i + 1]`` are those of row i."""

    ids: np.ndarray
    ends: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def take(self, rows: np.ndarray) -> Shard:
        sizes = np.diff(self.ends)[rows]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        at = np.arange(ends[-1]) + np.repeat(self.ends[rows] - ends[:-1], sizes)
        return Shard(self.ids[rows], ends, self.terms[at], self.values[at])

    def sums(self, entries: np.ndarray, a: int, b: int) -> np.ndarray:
        """Sums over the entries of each of the rows a to b; every row has one."""
        return np.add.reduceat(entries, self.ends[a:b] - self.ends[a])


@dataclass
class Queries:
    """The terms of each query; ``spaces[i]`` to ``spaces[i + 1]`` are the terms of space i."""

    names: list[int]
    terms: list[np.ndarray]
    spaces: np.ndarray

    @classmethod
    def of(cls, names: np.ndarray, words: pa.Array) -> tuple[Queries, list[bytes]]:
        """From (query, word) rows sorted by query, each once. Words are numbered by their space: those of a single
        query by query, then the others."""
        coded = words.dictionary_encode()
        code, n = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        uses = np.bincount(code, minlength=n)
        query, owner = np.zeros(n, np.int64), np.unique(names, return_inverse=True)[1]
        query[code] = owner
        space = np.where(uses == 1, query, owner.max() + 1 + np.arange(n))
        order = np.argsort(space, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        starts = np.flatnonzero(np.diff(space[order], prepend=-1))
        each = np.split(place[code], np.flatnonzero(np.diff(names)) + 1)
        return (cls(names[np.flatnonzero(np.diff(names, prepend=names[0] - 1))].tolist(), [np.sort(x) for x in each],
                    np.append(starts, n)), coded.dictionary.take(pa.array(order)).to_pylist())

    def space_of(self, terms: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.spaces, terms, "right") - 1


@dataclass
class BallTree:
    """Nodes over rows ``starts`` to ``stops`` of an ordered shard; children are at ``left`` and ``left`` + 1, 0 for leaves."""

    shard: Shard
    starts: list[int] = field(default_factory=list)
    stops: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    centres: list[np.ndarray] = field(default_factory=list)
    radii: list[np.ndarray] = field(default_factory=list)


def _radii(rows: Shard, values: np.ndarray, centre: np.ndarray, queries: Queries) -> np.ndarray:
    """In each space the largest distance of a row from the centre, never below the true one."""
    size = np.add.reduceat(centre * centre, queries.spaces[:-1])
    space = queries.space_of(rows.terms)
    run = np.flatnonzero((np.diff(space, prepend=-1) != 0) | np.isin(np.arange(len(space)), rows.ends[:-1]))
    norm, space = np.add.reduceat(values * values, run), space[run]
    exact = norm - 2 * np.add.reduceat(values * centre[rows.terms], run) + size[space]
    out = size * (1 + ROUNDING)  # rows without a term there
    np.maximum.at(out, space, np.maximum(exact, 0) + ROUNDING * (norm + size[space]))
    return np.sqrt(out) * (1 + ROUNDING)


def ball_tree(shard: Shard, queries: Queries, leaf_rows: int = LEAF_ROWS) -> BallTree:
    """A node is split between two far documents, at the median of the difference of the squared distances."""
    n_terms = int(queries.spaces[-1])
    order = np.arange(len(shard.ids))
    tree = BallTree(shard)
    todo = [(0, len(order))]
    while len(tree.starts) < len(todo):
        a, b = todo[len(tree.starts)]
        own = shard.take(order[a:b])
        values = own.values.astype(np.float64)
        norms = own.sums(values * values, 0, b - a)

        def squares(point: np.ndarray, own=own, values=values, norms=norms) -> np.ndarray:
            """Squared distances to a dense point."""
            return norms - 2 * own.sums(values * point[own.terms], 0, len(own.ids)) + float(point @ point)

        centre = np.bincount(own.terms, values, n_terms) / (b - a)
        left = 0
        if b - a > leaf_rows:
            ends, far = [], squares(centre)
            for _ in range(2):  # a document far from the centre, and one far from that
                i = int(far.argmax())
                point = np.bincount(own.terms[own.ends[i]:own.ends[i + 1]], values[own.ends[i]:own.ends[i + 1]], n_terms)
                ends.append(far := squares(point))
            order[a:b] = order[a:b][np.argsort(ends[0] - ends[1], kind="stable")]
            left, middle = len(todo), (a + b) // 2
            todo += [(a, middle), (middle, b)]
        tree.starts.append(a)
        tree.stops.append(b)
        tree.left.append(left)
        tree.centres.append(centre)
        tree.radii.append(_radii(own, values, centre, queries))
    tree.shard = shard.take(order)
    return tree


class Best:
    """The k best documents of a query so far: highest score, then smallest id (null: last)."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def worst(self) -> int:
        """The lowest score that still counts."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = np.flatnonzero(scores >= self.worst())
        if len(good):
            new = [(int(scores[i]), ids[i]) for i in good]
            self.rows = sorted(self.rows + new, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:self.k]


def search(tree: BallTree, queries: Queries, best: list[Best]) -> int:
    """Show a tree's documents to the queries; the number of documents scored."""
    def total(of_node: list[np.ndarray], places: list[np.ndarray], factors: list[np.ndarray] | None = None) -> np.ndarray:
        starts = np.concatenate(([0], np.cumsum([len(p) for p in places])[:-1]))
        each = np.array(of_node)[:, np.concatenate(places)]
        return np.add.reduceat(each if factors is None else each * np.concatenate(factors), starts, axis=1)

    spaces = [np.unique(queries.space_of(q), return_counts=True) for q in queries.terms]
    bounds = total(tree.centres, queries.terms) + total(tree.radii, [s for s, _ in spaces], [np.sqrt(n) for _, n in spaces])
    bounds = bounds * (1 + ROUNDING) + 1
    shard, scored = tree.shard, 0
    inside = np.zeros(int(queries.spaces[-1]), bool)
    for q, terms in enumerate(queries.terms):
        inside[terms] = True
        mine, bound = best[q], bounds[:, q].tolist()
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= mine.worst():
            node = heapq.heappop(heap)[1]
            if child := tree.left[node]:
                for c in (child, child + 1):
                    if bound[c] >= mine.worst():
                        heapq.heappush(heap, (-bound[c], c))
                continue
            a, b = tree.starts[node], tree.stops[node]
            part = slice(shard.ends[a], shard.ends[b])
            mine.add(shard.sums(np.where(inside[shard.terms[part]], shard.values[part], 0), a, b), shard.ids[a:b])
            scored += b - a
        inside[terms] = False
    return scored


def _search(batches: Iterator[pa.RecordBatch], statistics: Statistics, queries: Queries, k: int, shard_rows: int,
            id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    best, held, size = [Best(k) for _ in queries.names], [], 0

    def visit() -> None:
        rows = pa.Table.from_batches(held).combine_chunks()
        sizes = rows["terms"].combine_chunks().value_lengths().to_numpy()
        terms = rows["terms"].combine_chunks().flatten().to_numpy()
        values = statistics.entries(rows["n"].to_numpy(), sizes, terms, rows["tfs"].combine_chunks().flatten().to_numpy())
        ids = np.array([*rows["doc_id"].to_pylist(), None], object)[:-1]
        shard = Shard(ids, np.concatenate(([0], np.cumsum(sizes))), terms, values)
        search(ball_tree(shard, queries), queries, best)

    for batch in batches:
        filled = batch.filter(pc.greater(pc.list_value_length(batch.column("terms")), 0))
        while filled.num_rows:
            entries = size + np.cumsum(filled.column("terms").value_lengths().to_numpy())
            n = min(shard_rows - sum(h.num_rows for h in held), max(1, int(np.searchsorted(entries, SHARD_ENTRIES))))
            held.append(filled.slice(0, n))
            size, filled = int(entries[min(n, len(entries)) - 1]), filled.slice(n)
            if size >= SHARD_ENTRIES or sum(h.num_rows for h in held) >= shard_rows:
                visit()
                held, size = [], 0
    if held:
        visit()
    rows = [(name, doc, score) for name, b in zip(queries.names, best, strict=True) for score, doc in b.rows]
    if rows:
        query, doc, score = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(doc, id_type), pa.array(score, pa.int64())],
                                         names=["query", "doc_id", "score"])


def lexical_search(docs: DataFrame, items: DataFrame, *, k: int = TOP, length_percent: int = LENGTH_PERCENT,
                   shard_rows: int = SHARD_ROWS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``docs`` (doc_id, text) and ``items`` (item_id, text; other columns are ignored) -> item_id, rank (from 1),
    doc_id, score: the ``k`` documents of highest score above 0 for each row of ``items``.

    Equal scores go to the smaller doc_id, a null one after all others; repeated documents take a rank each.
    Null and empty texts have no terms: such documents are not found and not counted, such items have no rows.
    Every row of ``items`` is a query of its own, also with a null or repeated item_id. Empty tables give no rows.

    Items are taken in blocks of about ``block_terms`` terms, each with its own pass over the documents, so what
    a task holds of them is bounded; documents are in shards of at most ``shard_rows``."""
    spark = docs.sparkSession
    folder = run_folder(spark, "lexical")
    asked = materialize(items.select("item_id", "text", F.monotonically_increasing_id().alias("query")), f"{folder}/items")
    terms = materialize(asked.select("query", "text").mapInArrow(_item_terms, "query long, term binary"), f"{folder}/terms")
    n_blocks = max(1, math.ceil(terms.count() / block_terms))
    id_type = docs.schema["doc_id"].dataType
    found = None
    for i in range(n_blocks):
        mine = terms.filter(F.pmod(F.xxhash64("query"), F.lit(n_blocks)) == i).orderBy("query", "term").toArrow()
        if not len(mine):
            continue
        queries, words = Queries.of(mine["query"].to_numpy(), mine["term"].combine_chunks())
        places = {w: p for p, w in enumerate(words)}
        vectors = materialize(
            docs.select("doc_id", "text").mapInArrow(
                lambda b, places=places: _vectors(b, places),
                f"doc_id {id_type.simpleString()}, n long, terms array<int>, tfs array<int>"), f"{folder}/vectors-{i}")
        n_docs, n_terms = vectors.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = (vectors.select("terms").mapInArrow(lambda b, n=len(places): _holders(b, n), "term long, df long")
                .groupBy("term").agg(F.sum("df").alias("df")).toArrow())
        df = np.zeros(len(places), np.int64)
        df[held["term"].to_numpy()] = held["df"].to_numpy()
        weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        shared = spark.sparkContext.broadcast((Statistics(n_docs, n_terms, weights, length_percent), queries))
        arrow_id = _arrow_type(id_type)
        part = vectors.mapInArrow(lambda b, s=shared: _search(b, *s.value, k, shard_rows, arrow_id),
                                  f"query long, doc_id {id_type.simpleString()}, score long")
        found = part if found is None else found.union(part)
    if found is None:
        kinds = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {id_type.simpleString()}, score long"
        return spark.createDataFrame([], kinds)
    place = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return (found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
            .join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score"))


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
