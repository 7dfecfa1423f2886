"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns; parts of the methods."""

import base64
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kpiloom.llm import (covertree, langid, mixing, packing, quality, secrets, simhash, tokencount, tokenfile, warc)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, fp string"
ROWS = [
    (1, None, None, None, None, 1, "x", "y"),
    (2, "", "en", "a", 0, 1, "x", "y"),
    (3, "the cat sat on the mat again " * 3000, "en", "a", None, 1, "x", "y"),
    (4, "the cat sat on the mat again", "en", None, 28, 1, "x", "y"),
    (4, "the cat sat on the mat again", "en", None, 28, 1, "x", "y"),
    (None, "der Hund \x1f lief über die Straße", "de", "b", 31, 1, "x", "y"),
    (6, "12 34 !!", "de", "b", 8, 1, "x", "y"),
]
OVER_DOCS = {
    "mix": mixing.mix, "tokenfile": lambda d: tokenfile.read_token_files(tokenfile.write_token_files(d)),
    "simhash": simhash.simhash_groups, "pack": packing.pack, "secrets": secrets.scan,
    "langid": lambda d: langid.predict(d, langid.train(d)), "quality": quality.ledger,
    "tokencount": tokencount.token_counts,
    "redact": secrets.redact, "keep_known": lambda d: langid.keep_known(d, langid.train(d)),
    "apply_mix": lambda d: mixing.apply_mix(d, mixing.mix(d)),
}


@pytest.mark.parametrize("name", OVER_DOCS)
def test_rows_with_nulls_and_repeats(spark, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    rows = OVER_DOCS[name](docs).collect()
    assert (4 if name in ("keep_known", "apply_mix") else len(ROWS)) <= len(rows)


@pytest.mark.parametrize("name", OVER_DOCS)
def test_empty_tables(spark, name):
    assert OVER_DOCS[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_applied_mix_equals_plain_python(spark):
    """Ids, sources and sizes may be shared, null or repeated; columns may have the names of working columns."""
    from collections import Counter

    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice(["a b c", "d  e\tf", " g h i j", "k", "", None, "a b c"]), rng.choice([None, "x", "y"]),
             777, 888, "t", "r") for _ in range(300)] + [(9, "same words here", "z", 777, 888, "t", "r")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, nth long, tie string, row string")
    mixed = mixing.mix(docs)
    got = mixing.apply_mix(docs, mixed).collect()
    assert {(r["size"], r["nth"], r["tie"], r["row"]) for r in got} == {(777, 888, "t", "r")}

    def key(doc_id, source, text):
        return doc_id, source, len((text or "").split())

    takes, texts = {}, {}
    for r in mixed.collect():
        takes.setdefault((r.doc_id, r.source, r["size"]), []).append(r.taken)
    for doc_id, text, source, *_ in rows:
        texts.setdefault(key(doc_id, source, text), []).append(text)
    assert {k: len(v) for k, v in takes.items()} == {k: len(v) for k, v in texts.items()}
    words = lambda t: len((t or "").split())
    by_key = {}
    for r in got:
        whole = next((t for k, ts in texts.items() if k[:2] == (r.doc_id, r.source) for t in ts if t and t.startswith(r.text)), None)
        assert whole is not None  # a text, or its first words
        by_key[r.doc_id, r.source] = by_key.get((r.doc_id, r.source), 0) + words(r.text)
    want = {}
    for k, v in takes.items():
        want[k[:2]] = want.get(k[:2], 0) + sum(v)
    assert by_key == {k: n for k, n in want.items() if n}
    full = Counter((r.doc_id, r.source, r.text) for r in got)
    for k, ts in texts.items():  # every text at least as often as the least take of its key has whole epochs
        if k[2]:
            for t, n in Counter(ts).items():
                assert full[k[0], k[1], t] >= n * (min(takes[k]) // k[2])
    assert sum(full.values()) == sum(t // k[2] + (t % k[2] > 0) for k, v in takes.items() for t in v if k[2])


def test_simhash_of_edges(spark):
    rows = simhash.simhash_groups(spark.createDataFrame(ROWS, SCHEMA)).collect()
    by_id = {r.doc_id: (r.fingerprint, r.component_id) for r in rows}
    assert by_id[1] == by_id[2] == ("0" * 16, 1)
    assert by_id[4][1] in (3, 4) and len(rows) == len(ROWS)


def test_simhash_hot_anchor_equals_plain(spark):
    """The finer cover gives the same groups as the anchors."""
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(4))) for b in base for _ in range(6)}
    signed = [(int(np.uint64(v).astype(np.int64)),) for v in values]
    from kpiloom.llm.components import components
    from kpiloom.llm.shared import run_folder

    def groups(most_homes):
        folder = run_folder(spark, "test")
        df = spark.createDataFrame(signed, "fp long")
        return sorted(tuple(r) for r in components(simhash.linked(df, folder, most_homes=most_homes), folder).collect())

    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    plain = groups(20_000)
    assert groups(0) == plain
    by_root = {}
    for node, r in plain:
        by_root.setdefault(r, set()).add(node % (1 << 64))
    want = {}
    for v in values:
        want.setdefault(find(v), set()).add(v)
    assert sorted(map(sorted, by_root.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def _der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def test_structure_is_confirmed():
    rng = random.Random(1)
    key = _der(0x30, _der(2, b"\0") + b"".join(_der(2, b"\1" + rng.randbytes(40)) for _ in range(8)))
    assert secrets.is_private_key(key) and not secrets.is_private_key(key[:-1]) and not secrets.is_private_key(key + b"x")
    run = base64.b64encode(key).decode()
    assert ("base64_key", 4, 4 + len(run)) in secrets.confirmed_spans(f"see {run} end")
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(run[i:i + 64] for i in range(0, len(run), 64)) + "\n-----END RSA PRIVATE KEY-----"
    assert ("pem_key", 2, 2 + len(pem)) in secrets.confirmed_spans("é " + pem)
    assert ("hex_key", 0, 2 * len(key)) in secrets.confirmed_spans(key.hex())
    random_run = base64.b64encode(b"0\x82" + rng.randbytes(300)).decode()
    assert secrets.confirmed_spans(random_run) == []
    part = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256'})}.{part({'sub': 1})}.c2lnbmF0dXJl"
    assert ("signed_token", 0, len(token)) in secrets.confirmed_spans(token)
    assert secrets.confirmed_spans(f"{part({'typ': 'x'})}.{part({'sub': 1})}.c2ln") == []


def test_redaction_leaves_the_rest(spark):
    docs = spark.createDataFrame([(1, 'é token = "24be64439e3e49cf46b2d7c90f3602a3" end', 99), (2, "clean", 5), (3, None, None)],
                                 "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in secrets.redact(docs).orderBy("doc_id").collect()] == [
        (1, 'é [SECRET]" end', 15), (2, "clean", 5), (3, None, None)]


def test_hilbert_neighbours_touch():
    bits = 3
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_viterbi_equals_all_paths():
    import itertools

    rng = np.random.default_rng(2)
    for _ in range(60):
        scores = rng.normal(0, 4, (6, 3))
        best = max(itertools.product(range(3), repeat=6),
                   key=lambda p: sum(scores[i, l] for i, l in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:], strict=False)))
        assert langid.best_path(scores, 3.0).tolist() == list(best)


def test_mixed_text_has_spans(spark):
    en, de = "the cat sat on the mat with another hat " * 8, "der Hund lief über die Straße nach Hause zurück " * 8
    docs = spark.createDataFrame([(i, en if i % 2 else de, "en" if i % 2 else "de") for i in range(20)],
                                 "doc_id long, text string, lang string")
    model = langid.train(docs)
    lang, share, spans = langid.label(en + de, model)
    assert [s[0] for s in spans] == ["en", "de"] and 0.4 < share < 0.7
    assert langid.label("12 !!", model) == ("und", 0.0, [])


def test_ledger_policies(spark):
    docs = spark.createDataFrame([(1, "word " * 19), (2, " ".join(f"word{i}" for i in range(40))), (3, "a b c d e f g h " * 9)],
                                 "doc_id long, text string")
    entries = quality.ledger(docs)
    kept = {r[0] for r in entries.filter(quality.keeps("clean-1")).select("doc_id").collect()}
    assert kept == {2}
    cut = {r.rule: (r.n_failed, r.n_only, r.n_rejected) for r in quality.ablations(entries, "base-1").collect()}
    assert cut["few_words"][0] == 1 and cut["repeated_words"][0] == 2 and cut["few_words"][2] == 2


def test_top_k_edges(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(1, 400)]
    rows += [(400, None), (450, [float("nan"), 0.0, 0.0]), (500, [None, 0.0, 0.0]), (550, [0.5]), (600, []),
             (None, [1.0, 1.0, 1.0]), (50, rows[49][1])] + [(1000 + i, [1.0, 1.0, 1.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("width", F.lit("clash"))
    got = covertree.top_k(df, F.col("vec_id") % 50 == 0, sample_rows=32, block_rows=64, group_queries=4, shard_blocks=1)
    sound = {i: np.floor(np.array(v) * 256).astype(int) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q, v in sound.items():
        if q % 50 == 0:
            best = sorted((-int(v @ w), j) for j, w in sound.items() if j != q and len(w) == len(v))[:5]
            want += [(q, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert covertree.top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_archives_in_segments(spark):
    html = ["", None, "a" * 5000, "é" * 700, "a" * 5000, "x\r\n0\r\n\r\ny"]
    pages = spark.createDataFrame([(i, f"http://e/{i}\n", h, "z") for i, h in enumerate(html)] + [(None, None, "é" * 700, "z")],
                                  "page_id long, url string, html string, sha string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages, segment_bytes=100).collect()}
    assert got == {0: (0, "response", None), 1: (0, "revisit", 0), 2: (5000, "response", None), 3: (1400, "response", None),
                   4: (5000, "revisit", 2), 5: (9, "response", None), None: (1400, "revisit", 3)}
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_repeated_pages_have_one_response(spark):
    """Of rows alike in id and payload one is the response; ids and urls may be null or differ."""
    rows = [(1, "u", "x" * 50)] * 3 + [(2, "u", "x" * 50), (1, "a", "x" * 50), (None, None, "x" * 50), (1, "u", "other"),
                                       (None, "n", "nobody's"), (None, None, "nobody's"), (5, "s", ""), (5, "s", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    assert got == sorted([(1, 50, "response", None), *[(1, 50, "revisit", 1)] * 3, (2, 50, "revisit", 1), (None, 50, "revisit", 1),
                          (1, 5, "response", None), (None, 8, "response", None), (None, 8, "revisit", None),
                          (5, 0, "response", None), (5, 0, "revisit", 5)], key=str)
    small = warc.round_trip(pages, least=6).collect()
    assert len(small) == len(rows)
    assert sorted((r.page_id, r.record_type) for r in small if r.payload_bytes < 6) == [(1, "response"), (5, "response"), (5, "response")]


def test_every_archive_is_read_by_a_task_of_its_own(spark):
    manifest = spark.createDataFrame([(f"file:///none/part-{i:06d}.warc.gz",) for i in range(20)], "uri string")
    assert warc.spread(manifest).select(F.spark_partition_id()).distinct().count() == 20


def test_broken_segments_are_found():
    part = lambda n, block, total=None: {"segment": n, "block": block, "total": total, "origin": "o"}
    assert warc.reassembled([part(2, b"b", 2), part(1, b"a"), part(1, b"a")]) == b"ab"
    for bad in ([part(1, b"a"), part(3, b"c", 2)], [part(1, b"a"), part(2, b"b", 3)], [part(2, b"b", 1)]):
        with pytest.raises(ValueError):
            warc.reassembled(bad)
    assert warc.dechunked(warc.chunked(b"abc" * 9, 4)) == b"abc" * 9
    with pytest.raises(ValueError):
        warc.dechunked(b"3\r\nabcd\r\n0\r\n\r\n")
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nEtag: z\r\nA: b\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"3\r\nabc\r\n0\r\n\r\nmore\r\n\r\n")


def test_random_windows_of_other_lengths():
    assert quality.repeat_words(pa.array(["a b a b", "", "a a a"]), 2).tolist() == [4, 0, 3]


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, out, sf)
        assert out.columns == docs.columns, name
    groups = simhash.simhash_groups(langid.keep_known(docs, langid.train(docs, where=~langid.held_out()))).toPandas()
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(groups.component_id.unique())
    pieces = corpus_pipeline.run(spark, sf).toPandas()
    assert (pieces.groupby("sequence_id").length.sum().sort_index().iloc[:-1] == packing.CAPACITY).all()
