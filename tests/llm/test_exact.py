"""The pipeline, and operators on rows with nulls and repeats, row by row against plain Python."""

import hashlib
import re
from collections import Counter

import pytest

import corpus_pipeline
from kpiloom.llm import langid, mixing, packing, quality, secrets, simhash, tokencount, tokenfile
from tests.llm.test_edges import ROWS, SCHEMA
from tests.llm.test_operators import SF, WORD, _crc, _ids, brute_fingerprint, brute_quality, tokenizer  # noqa: F401
from tests.llm.test_whole_job import brute_label


def words(text):
    return WORD.findall(text or "")


def groups(fps):
    """Root of each place, where fingerprints within 4 bits are linked."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def mixed(docs):
    """(doc_id, source, text) -> the texts of the mix: whole epochs, and the first words of the one at the cut."""
    sizes = Counter()
    for _, source, text in docs:
        sizes[source] += len(words(text))
    ranked = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(ranked)}
    open_, target, left = set(sizes), {}, 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] < weight[s] * level}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    key = lambda d: int(hashlib.md5(f"{'' if d[0] is None else d[0]}:mix-1".encode()).hexdigest()[:8], 16)
    at, out = Counter(), []
    for doc_id, source, text in sorted(docs, key=lambda d: (key(d), d[0] is not None, d[0] or 0, len(words(d[2])))):
        n = len(words(text))
        if not n:
            continue
        epochs, rest = divmod(int(target[source] + 1e-9), sizes[source])
        part = max(0, min(n, rest - at[source]))
        at[source] += n
        out += [(doc_id, text)] * (epochs + (part == n))
        if 0 < part < n:
            out.append((doc_id, text[:list(WORD.finditer(text))[part - 1].end()]))
    return out


def check_pieces(rows, wanted, encode):
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of the texts ``wanted`` [(doc_id, text)]."""
    texts = {}
    for doc_id, text in wanted:
        ids = [*encode(text), 2]
        texts.setdefault((doc_id, len(ids)), []).append(ids)
    pieces = {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    assert set(pieces) == set(texts)
    for key, found in pieces.items():
        cover = Counter(i for start, length, _ in found for i in range(start, start + length))
        assert cover == {i: len(texts[key]) for i in range(key[1])}
        assert all(any(crc == _crc(ids[start:start + length]) for ids in texts[key]) for start, length, crc in found)


def test_pipeline_equals_plain_python(spark, tokenizer):  # noqa: F811
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text").collect()]
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"), where=~langid.held_out())
    told = [brute_label(text or "", model) for _, _, text in docs]
    assert None not in told
    kept = [d for d, (lang, score) in zip(docs, told, strict=True) if lang != "und" and score >= 0.3]
    root = groups([brute_fingerprint(text) for _, _, text in kept])
    leads = {}
    for d, r in zip(kept, root, strict=True):
        leads[r] = min(leads.get(r, d), d, key=lambda x: x[0])
    clean = []
    for doc_id, source, text in leads.values():
        spans = sorted((a, b) for _, a, b in secrets.base_spans(text) + secrets.confirmed_spans(text))
        out, at = "", 0
        while spans:
            a, b = spans.pop(0)
            while spans and spans[0][0] < b:
                b = max(b, spans.pop(0)[1])
            out, at = out + text[at:a] + "[SECRET]", b
        clean.append((doc_id, source, out + text[at:]))
    assert any("[SECRET]" in t for _, _, t in clean) and 0 < len(clean) < len(kept) < len(docs) + 1
    rows = [r.asDict() for r in corpus_pipeline.run(spark, SF).collect()]
    check_pieces(rows, mixed(clean), lambda t: _ids(tokenizer, t))


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_counts_and_files_of_odd_rows(odd, tokenizer):  # noqa: F811
    ids = [(r[0], r[1], _ids(tokenizer, r[1])) for r in ROWS]
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.token_counts(odd).collect()) == Counter(
        (d, len((t or "").encode()), len(i), len(i) > 2048) for d, t, i in ids)
    files = tokenfile.read_token_files(tokenfile.write_token_files(odd)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in files) == Counter((d, len(i) + 1, _crc([*i, 1])) for d, _, i in ids)
    starts = sorted((r.start, r.n_tokens) for r in files)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    order = [r.doc_id for r in sorted(files, key=lambda r: r.start) if r.doc_id is not None]
    assert order == sorted(order)


def test_groups_and_measures_of_odd_rows(odd):
    fps = [brute_fingerprint(r[1]) for r in ROWS]
    root = groups(fps)
    ids = {}
    for r, g in zip(ROWS, root, strict=True):
        ids.setdefault(g, []).append(r[0])
    first = {g: min((i for i in x if i is not None), default=None) for g, x in ids.items()}
    assert rows_of(simhash.simhash_groups(odd)) == Counter((r[0], f"{fp:016x}", first[g]) for r, fp, g in zip(ROWS, fps, root, strict=True))
    assert simhash.keep_one(odd).count() == len(ids)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert rows_of(quality.ledger(odd).select(*names)) == Counter((r[0], *brute_quality(r[1])) for r in ROWS)


def test_spans_labels_and_pieces_of_odd_rows(odd, tokenizer):  # noqa: F811
    nothing = hashlib.sha256(b"").hexdigest()
    assert rows_of(secrets.scan(odd)) == Counter((r[0], 0, 0, 0, nothing, "") for r in ROWS)
    same = [tuple(len(r[1]) if i == 4 and v is not None and r[1] is not None else v for i, v in enumerate(r)) for r in ROWS]
    assert rows_of(secrets.redact(odd)) == Counter(same)
    model = langid.train(odd)
    told = {i: brute_label(r[1] or "", model) for i, r in enumerate(ROWS)}
    assert None not in told.values()
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.predict(odd, model).collect())
    assert got == Counter((r[0], told[i][0], round(told[i][1], 9)) for i, r in enumerate(ROWS))
    kept = Counter(r for i, r in enumerate(ROWS) if told[i][0] != "und" and told[i][1] >= 0.3)
    assert rows_of(langid.keep_known(odd, model)) == kept and sum(kept.values()) == 4
    check_pieces([r.asDict() for r in packing.pack(odd).collect()], [(r[0], r[1]) for r in ROWS], lambda t: _ids(tokenizer, t))


def test_takes_of_odd_rows(odd):
    takes = mixing.mix(odd).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in takes) == Counter((r[0], r[3], len(words(r[1]))) for r in ROWS)
    wanted = Counter((doc_id, re.sub(r"\s+", " ", text)) for doc_id, text in mixed([(r[0], r[3], r[1]) for r in ROWS]))
    got = Counter((r.doc_id, re.sub(r"\s+", " ", r.text)) for r in mixing.apply_mix(odd, mixing.mix(odd)).collect())
    assert got == wanted
