"""Importance resampling, the n-gram Jaccard join and ranked lexical search against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kpiloom.llm import jaccard, lexical, resample

LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n long, weight long, row string, key string, terms string, query string"
EXTRA = (7, 8, "row", "key", "terms", "query")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


def items(spark, rows):
    return spark.createDataFrame([(*r, "row", 1.0) for r in rows], "item_id long, text string, doc_id string, score double")


EDGES = [
    (1, None), (2, ""), (3, " \t !! \x00 -- "), (4, "the cat sat on the mat again " * 3000), (5, "the cat sat on the mat again"),
    (5, "the cat sat on the mat again"), (None, "der Hund lief über die Straße und ÜBER die Brücke"), (None, None),
    (7, "The CAT sat on the mat again"), (8, "cat"), (9, "CAT"), (10, "one two three"), (11, "a\x0bb\x1cc d e f g")]


# ---- resampling

def brute_resample(docs, target, longest, buckets, percent, least):
    def features(text):
        words = LETTERS.findall(lowered(text))
        return len(words), [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    raw, wanted = (Counter(bucket(f) for t in texts for f in features(t)[1]) for texts in ([t for _, t in docs], target))
    s, t = sum(raw.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets))))
    rows = []
    for doc, text in docs:
        n, fs = features(text)
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((n, doc, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[0] >= least), key=lambda r: (-r[4], r[1] is not None, r[1] or 0, r[2]))
    drawn = percent * len(able) // 100
    out = [(*r[1:], i + 1 if i < drawn else None) for i, r in enumerate(able)]
    return Counter(out + [(*r[1:], None) for r in rows if r[0] < least])


@pytest.mark.parametrize("longest", [1, 3])
def test_resample_equals_plain(spark, longest):
    rng = random.Random(longest)
    vocabulary = ["Ab", "é", "été", "x1", "the", "of", "日本", "z" * 40, "And"]
    docs = EDGES + [(rng.choice([i, i, None, 30]), " ".join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(20, 160)]
    docs += [(40, "of the été " * 10)] * 30  # rows alike in everything
    target = ["the of été", None, "", "the THE x1 日本"]
    got = resample.resample(table(spark, docs), items(spark, [(1, t) for t in target]), longest=longest, buckets=50, percent=40,
                            min_words=5, rows_each=20)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == brute_resample(docs, target, longest, 50, 40, 5)


def test_resample_empty_tables(spark):
    assert resample.resample(table(spark, []), items(spark, [(1, "a")])).collect() == []
    rows = resample.resample(table(spark, [(1, "a b"), (2, None)]), items(spark, []), min_words=1, percent=100).collect()
    assert {r.doc_id: (r.n_features, r.rank) for r in rows} == {1: (2, 1), 2: (0, None)}


# ---- Jaccard join

def brute_sets(docs):
    out = []
    for _, text in docs:
        words = WORD.findall(lowered(text))
        out.append({" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))} if words else set())
    return out


def brute_groups(docs, percent):
    sets = brute_sets(docs)
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    members = {}
    for i in range(len(docs)):
        members.setdefault(find(i), []).append(i)
    out = Counter()
    for group in members.values():
        ids = [docs[i][0] for i in group if docs[i][0] is not None]
        out.update((docs[i][0], len(sets[i]), min(ids) if ids else None) for i in group)
    return out


def near_copies(rng, base, n, edits):
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**9)}"
        yield " ".join(words)


def corpus(rng):
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    texts = [t for _, t in EDGES]
    passage = [f"line{i}" for i in range(40)]
    for size, copies, edits in [(5, 8, 1), (12, 12, 1), (34, 20, 2), (66, 20, 3), (130, 60, 8), (300, 25, 16), (900, 15, 45)]:
        texts += near_copies(rng, [word() for _ in range(size)], copies, edits)
    for size in (10, 30, 60, 61, 62, 120):  # documents that share a passage only
        texts += [" ".join([word() for _ in range(size)] + passage) for _ in range(6)]
    grown = [word() for _ in range(400)]
    texts += [" ".join(grown[:n]) for n in range(40, 400, 7)]  # a chain of links, over the borders of sizes
    rng.shuffle(texts)
    return [(i if i % 9 else None, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("percent, pair_rows, block_rows, centres", [(85, 64, 2048, 3), (85, 2, 3, 1), (85, 3, 5, 2), (60, 4, 8, 1)])
def test_jaccard_groups_equal_plain(spark, percent, pair_rows, block_rows, centres):
    docs = corpus(random.Random(percent + pair_rows))
    got = jaccard.jaccard_groups(table(spark, docs), percent=percent, pair_rows=pair_rows, block_rows=block_rows, centres=centres)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(tuple(r) for r in got.collect()) == brute_groups(docs, percent)


def test_jaccard_of_empty_table(spark):
    assert jaccard.jaccard_groups(table(spark, [])).collect() == []
    assert [tuple(r) for r in jaccard.jaccard_groups(table(spark, [(3, None)])).collect()] == [(3, 0, 3)]


@pytest.mark.parametrize("percent", [50, 85, 95])
def test_linked_sets_share_a_digest(percent):
    """Sets at the very bound of the similarity meet, at all sizes; parities never discard them."""
    rng = np.random.default_rng(percent)
    for _ in range(600):
        n = int(rng.integers(1, 700))
        union = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        spare = len(union) - -(-percent * len(union) // 100)
        left = int(rng.integers(0, spare + 1))
        drop = rng.permutation(len(union))[:spare]
        x, y = np.delete(union, drop[:left]), np.delete(union, drop[left:])
        if len(x) and len(y):
            assert jaccard.overlaps(x, y, percent)
            assert jaccard._differing(jaccard.parities(x), jaccard.parities(y)) <= jaccard.allowed(len(x), len(y), percent)
            if spare:
                assert np.intersect1d(jaccard.digests(x, percent), jaccard.digests(y, percent)).size
        if spare and len(union) > spare + 1:  # one entry less in common
            extra = np.delete(union, rng.permutation(len(union))[:spare + 1])
            assert not jaccard.overlaps(extra, union, percent)


def test_meet_across_batches():
    """Keys cut by batches give all pairs, or all members."""
    rng = random.Random(1)
    rows = sorted((rng.randrange(40), rng.randrange(12)) for _ in range(600))
    want_pairs, want_members = set(), set()
    for key, group in itertools.groupby(rows, key=lambda r: r[0]):
        own = sorted({r for _, r in group})
        if len(own) > 9:
            want_members |= {(key, r) for r in own}
        else:
            want_pairs |= set(itertools.combinations(own, 2))
    for size in (1, 2, 7, 600):
        batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in part]), pa.array([r for _, r in part])], names=["key", "row"])
                   for part in (rows[i:i + size] for i in range(0, len(rows), size))]
        out = [tuple(r.values()) for b in jaccard._meet(iter(batches), 9) for r in b.to_pylist()]
        assert {(a, b) for k, a, b in out if k is None} == want_pairs
        members = [(k, a) for k, a, _ in out if k is not None]
        assert set(members) == want_members and len(members) == len(want_members)


# ---- lexical search

def brute_search(docs, asked, k):
    words = [LETTERS.findall(lowered(t)) for _, t in docs]
    n_docs, n_terms = sum(map(bool, words)), sum(map(len, words))
    df = Counter(w for x in words for w in set(x))
    out = Counter()
    for item, text in asked:
        scores = []
        for (doc, _), x in zip(docs, words, strict=True):
            tf = Counter(x)
            if not x:
                continue
            m = 100 - 90 + 90 * len(x) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
                        for t in set(LETTERS.findall(lowered(text))) if t in tf)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out.update((item, i, doc, -s) for i, (s, _, _, doc) in enumerate(sorted(scores, key=lambda r: r[:3])[:k], 1))
    return out


@pytest.mark.parametrize("shard_rows, block_terms, k", [(4096, 50_000, 10), (7, 20, 3)])
def test_lexical_search_equals_plain(spark, shard_rows, block_terms, k):
    rng = random.Random(shard_rows)
    vocabulary = [f"w{i}" for i in range(60)] + ["été", "Straße", "THE", "x" * 300]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = EDGES + [(rng.choice([i, None, 50]), " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 80)))) for i in range(20, 300)]
    docs += [(900 - i, "w50 w51 été tie") for i in range(40)]
    asked = [(i % 9 or None, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 9)))) for i in range(30)]
    asked += [(1, None), (2, ""), (3, "unseen words only"), (4, "tie tie TIE"), (5, "cat, the cat. CAT!")]
    got = lexical.lexical_search(table(spark, docs), items(spark, asked), k=k, shard_rows=shard_rows, block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == brute_search(docs, asked, k)


def test_lexical_search_empty_tables(spark):
    assert lexical.lexical_search(table(spark, []), items(spark, [(1, "a")])).collect() == []
    assert lexical.lexical_search(table(spark, [(1, "a")]), items(spark, [])).collect() == []
    assert lexical.lexical_search(table(spark, [(1, None)]), items(spark, [(1, "a"), (2, None)])).collect() == []


def test_bounds_hold_and_prune():
    """No document scores above the bound of a node that holds it; nodes without a query's terms are passed over."""
    rng = np.random.default_rng(2)
    names = np.repeat(np.arange(12), 6)
    words = [f"{'common' if j < 2 else q}-{j}" for q in range(12) for j in range(6)]
    queries, terms = lexical.Queries.of(names, pa.array([w.encode() for w in words]))
    assert [sorted(terms[t].decode() for t in q) for q in queries.terms] == [sorted(words[6 * i:6 * i + 6]) for i in range(12)]
    rows = [np.unique(np.concatenate((rng.choice(queries.terms[rng.integers(12)], 3), rng.integers(0, len(terms), 1)))) for _ in range(600)]
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    shard = lexical.Shard(np.arange(600).astype(object), ends, np.concatenate(rows), rng.integers(1, 1 << 34, ends[-1]))
    tree = lexical.ball_tree(shard, queries, 8)
    best = [lexical.Best(5) for _ in range(12)]
    scored = lexical.search(tree, queries, best)
    assert scored < 0.7 * 600 * 12
    for q, b in zip(queries.terms, best, strict=True):
        inside = np.isin(shard.terms, q)
        scores = np.add.reduceat(np.where(inside, shard.values, 0), ends[:-1])
        want = sorted(((-int(s), i) for i, s in enumerate(scores) if s > 0))[:5]
        assert [(s, i) for s, i in b.rows] == [(-s, i) for s, i in want]
