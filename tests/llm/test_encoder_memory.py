"""What a worker holds while it encodes."""

import tracemalloc
from types import SimpleNamespace

import corpus_pipeline
import pyarrow as pa
import pytest

from kpiloom.llm import packing
from kpiloom.llm.tokens import DEFAULT_TOKENIZER, TextEncoder


@pytest.fixture
def batch():
    texts = [" ".join(f"w{(i * 7919 + j * j) % 30_011} tail" for j in range(700)) for i in range(800)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])


def encoded(monkeypatch, batch, *size):
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    tracemalloc.start()
    rows = []
    for out in packing._encode(iter([batch]), DEFAULT_TOKENIZER, 2, *size):
        rows += zip(*(out.column(c).to_pylist() for c in ("row", "doc_id", "key", "n")), map(hash, out.column("ids").to_pylist()), strict=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return rows, peak


def test_packing_in_the_pipeline_holds_a_small_block(monkeypatch, batch):
    """The same rows as from the operator's own blocks, in less than half of their memory."""
    packing.encoder(DEFAULT_TOKENIZER)
    rows, least = encoded(monkeypatch, batch, corpus_pipeline.PACK_BLOCK_BYTES)
    assert [r[0] for r in rows] == list(range(800))
    whole, most = encoded(monkeypatch, batch)
    assert rows == whole and least < most / 2


def test_known_pieces_are_bounded():
    """Words that never come again don't stay for the worker's life."""
    enc, letters = TextEncoder(), "abcdefghijklmnopqrstuvwxyz"
    for part in range(12):
        words = [f"{letters[i % 26]}{letters[i // 26 % 26]}{letters[i // 676 % 26]}{letters[part]}q" for i in range(17_000)]
        list(enc.each(pa.array([" ".join(words)])))
        assert len(enc.pieces) <= 120_000
    list(enc.each(pa.array(["aaaaq"])))
    assert enc.pieces
