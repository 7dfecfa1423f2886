"""The registered queries against brute force on the small tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kpiloom.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def _rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def _ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1_takes(spark, docs):
    rows = _rows(queries.op1_mix_sources(spark, SF))
    size = {d: len(WORD.findall(t or "")) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    assert {r["doc_id"]: r["size"] for r in rows} == size
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    source = dict(zip(docs.doc_id, docs.source, strict=True))
    taken, target = Counter(), {}
    for r in rows:
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_op2_and_op10_ids(spark, docs, tokenizer):
    start, want, counts = 0, [], {}
    for d, t in sorted(zip(docs.doc_id, docs.text, strict=True)):
        ids = _ids(tokenizer, t)
        counts[d] = (len((t or "").encode()), len(ids), len(ids) > 2048)
        want.append((d, start, len(ids) + 1, _crc([*ids, 1])))
        start += len(ids) + 1
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in _rows(queries.op2_token_files(spark, SF)))
    assert got == want
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"])
            for r in _rows(queries.op10_token_counts(spark, SF))} == counts


def brute_fingerprint(text):
    import xxhash

    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op3_groups(spark, docs):
    fp = {d: brute_fingerprint(t) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    ids, root = sorted(fp), {d: d for d in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if (fp[a] ^ fp[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {d: (f"{fp[d]:016x}", find(d)) for d in ids}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in _rows(queries.op3_simhash_groups(spark, SF))} == want


def test_op4_pieces(spark, docs, tokenizer):
    rows = _rows(queries.op4_pack_sequences(spark, SF))
    ids = {d: [*_ids(tokenizer, t), 2] for d, t in zip(docs.doc_id, docs.text, strict=True)}
    covered, used = Counter(), {}
    for r in rows:
        mine = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(mine) and r["length"] > 0
        assert r["ids_crc32"] == _crc(mine[r["start"]:r["start"] + r["length"]])
        covered[r["doc_id"]] += r["length"]
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert covered == {d: len(x) for d, x in ids.items()}
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(used) == -(-sum(map(len, ids.values())) // 4096)


def test_op5_base_spans(spark, docs):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                        re.IGNORECASE | re.ASCII)
    want = {}
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        t = t or ""
        a = [("assign", *m.span()) for m in assign.finditer(t) if len(m.group(2)) >= 12]
        k = [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 18]
        h = [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 16]
        order = ("assign", "access", "hex")
        text = ",".join(f"{x}:{y}:{z}" for x, y, z in sorted(a + k + h, key=lambda s: (s[1], order.index(s[0]))))
        want[d] = (len(a), len(k), len(h), hashlib.sha256(text.encode()).hexdigest())
    got = _rows(queries.op5_secret_scan(spark, SF))
    assert {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got} == want


def test_op6_equals_brute_force(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    e = e[[v is not None and all(x is not None and np.isfinite(x) for x in v) for v in e.embedding]]
    v = np.floor(np.array([np.asarray(x, np.float64) for x in e.embedding]) * 256).astype(np.int64)
    ids = e.vec_id.to_numpy()
    want = []
    for i in np.flatnonzero(ids % 50 == 0):
        best = sorted((-int(s), int(j)) for s, j in zip(v @ v[i], ids, strict=True) if j != ids[i])[:5]
        want += [(int(ids[i]), n, j, -s) for n, (s, j) in enumerate(best, 1)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in _rows(queries.op6_top_k(spark, SF)))
    assert got == sorted(want)


def test_op7_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    lang = dict(zip(docs.doc_id, docs.lang, strict=True))
    rows = _rows(queries.op7_language_id(spark, sf))
    assert len(rows) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    judged = [r for r in rows if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in judged) >= 0.97 * len(judged)


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_op8_measures(spark, docs):
    for r in _rows(queries.op8_quality_rules(spark, SF)):
        text = docs.text[docs.doc_id == r["doc_id"]].iloc[0]
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert got == brute_quality(text)
        assert r["base_failed"] == (got[0] < 20 or 100 * got[4] > 30 * got[0])
        assert not (r["base_failed"] and r["kept"])


def test_op9_records(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas()
    first = {}
    for p, h in sorted(zip(pages.page_id, pages.html, strict=True)):
        first.setdefault(h or "", p)
    want = {}
    for p, h in zip(pages.page_id, pages.html, strict=True):
        h = h or ""
        lead = first[h] == p
        want[p] = (len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(),
                   "response" if lead else "revisit", None if lead else first[h])
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
           for r in _rows(queries.op9_warc_archives(spark, SF))}
    assert got == want


def test_random_word_windows():
    import pyarrow as pa

    from kpiloom.llm.quality import repeat_words

    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(40))) + rng.choice(["", " ", "\n"]) for _ in range(200)]
    assert repeat_words(pa.array(texts)).tolist() == [brute_quality(t)[4] for t in texts]
