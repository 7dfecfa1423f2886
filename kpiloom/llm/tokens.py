"""Token ids of whole texts with a public tokenizer file, each distinct word encoded once a block.

For a tokenizer whose normaliser and pre-tokenizer treat white space as a boundary (the word BPE
file: NFC, white space to one blank, lower case, split by a letter/digit/symbol pattern), the ids of
a text are the ids of its white-space separated chunks in order, and those of a plain chunk are the
ids of its pieces. A block of texts is split and its distinct chunks are found by Arrow; the library
encodes the pieces that the worker has not met yet. Every other tokenizer encodes whole texts.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The settings under which chunks can be encoded apart, and the tokenizer's own pattern.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
                     {"type": "Lowercase"}]

#: Plain chunks have printable Latin-1 characters only: NFC leaves them as they are, and their lower
#: case and character classes are the same in every Unicode version.
_PLAIN = re.compile("[!-~¡-¬®-ÿ]+").fullmatch
_ALL_PLAIN = re.compile("[ -~¡-¬®-ÿ]*").fullmatch
#: The pattern above for lower-case plain chunks joined by a blank.
_PIECES = re.compile(r" |'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^ a-zªµºß-öø-ÿ0-9²³¹¼½¾]+").findall

DEFAULT_TOKENIZER = "word_bpe_49k.json"
BLOCK_BYTES = 8 << 20


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    """Where a public tokenizer file lies on this machine (asked on each executor)."""
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


def tokenizer_digest(name: str = DEFAULT_TOKENIZER) -> str:
    """Version of a tokenizer: SHA-256 of its file, 32 hex digits."""
    with open(tokenizer_path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


def take_ragged(flat: np.ndarray, ends: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs ``index`` of a ragged array (run i ends at ends[i]): their values in order, and their ends."""
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    lengths = (ends - starts)[index]
    out = np.cumsum(lengths)
    total = int(out[-1]) if len(out) else 0
    return flat[np.repeat(starts[index] - (out - lengths), lengths) + np.arange(total)], out


def ragged(parts: list[bytes], dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // dtype.itemsize
    return np.frombuffer(b"".join(parts), dtype), np.cumsum(lengths)


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[pa.Array]:
    """Slices of a string array of about ``size`` bytes; one longer text is a slice of its own."""
    n = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(n, (n[start - 1] if start else 0) + size, "right")))
        yield texts.slice(start, stop - start)
        start = stop


class TextEncoder:
    """Ids of texts with one tokenizer file; ``dtype`` has 2 bytes an id if the vocabulary allows."""

    def __init__(self, name: str = DEFAULT_TOKENIZER, max_pieces: int = 100_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        path = tokenizer_path(name)
        self.max_pieces, self.pieces, self.by_word, self.special = max_pieces, {}, False, []
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            size = model.vocab_size()
            self.whole = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            full = Tokenizer.from_file(path)
            size = full.get_vocab_size(with_added_tokens=True)
            self.whole = lambda texts: [x.ids for x in full.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self.by_word = self._splits_at_space(spec)
            self.special = [t["content"] for t in spec.get("added_tokens") or []]
            self._merge, self._bytes = full.model.tokenize, byte_letters()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")

    @staticmethod
    def _splits_at_space(spec: dict) -> bool:
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers") or [{}]
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and t["content"].split() == [t["content"]]
                    for t in spec.get("added_tokens") or [])
        return (plain and norm.get("normalizers") == _WORD_NORMALIZERS and len(steps) == 2
                and steps[0].get("pattern") == {"Regex": _WORD_PATTERN} and steps[0].get("behavior") == "Removed"
                and steps[0].get("invert") is True and steps[1].get("type") == "ByteLevel"
                and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space")
                and spec.get("post_processor") is None)

    def _pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case pieces; the library merges those that the worker has not met yet."""
        known = self.pieces
        if len(known) > self.max_pieces:
            known.clear()
        for word in [w for w in words if w not in known]:
            known[word] = np.array([t.id for t in self._merge(word.translate(self._bytes))], self.dtype).tobytes()
        return ragged([known[w] for w in words], self.dtype)

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks without white space."""
        joined = " ".join(chunks)
        special = any(s in joined for s in self.special)
        if not special and _ALL_PLAIN(joined):
            return self._plain(joined, len(chunks))
        plain = [bool(not c or _PLAIN(c)) and not any(s in c for s in self.special) for c in chunks]
        some = [c for c, p in zip(chunks, plain, strict=True) if p]
        rest = [c for c, p in zip(chunks, plain, strict=True) if not p]
        flat, ends = self._plain(" ".join(some), len(some))
        flat2, ends2 = ragged([np.array(x, self.dtype).tobytes() for x in self.whole(rest)], self.dtype)
        both = np.concatenate((ends, ends2 + len(flat)))
        order = np.empty(len(chunks), np.int64)
        order[np.flatnonzero(plain)] = np.arange(len(some))
        order[np.flatnonzero(~np.array(plain, bool))] = len(some) + np.arange(len(rest))
        return take_ragged(np.concatenate((flat, flat2)), both, order)

    def _plain(self, joined: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        found = pa.array(_PIECES(joined.lower()), pa.string()).dictionary_encode()
        words, codes = found.dictionary.to_pylist(), found.indices.to_numpy()
        gap = np.zeros(len(codes), bool)
        if " " in words:
            blank = words.index(" ")
            gap, words[blank] = codes == blank, ""
        flat, ends = self._pieces(words)
        out, piece_ends = take_ragged(flat, ends, codes)
        at = np.append(np.flatnonzero(gap), len(codes))[:n]  # a chunk ends before its blank
        return out, np.where(at > 0, piece_ends[np.maximum(at, 1) - 1], 0) if len(piece_ends) else np.zeros(n, np.int64)

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word:
            return ragged([np.array(x, self.dtype).tobytes() for x in self.whole(texts.to_pylist())], self.dtype)
        # in their own case: NFC comes before Lowercase, and some letters compose in lower case only
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        chunks = words.dictionary.to_pylist()
        flat, ends = self._chunks(chunks)
        out, word_ends = take_ragged(flat, ends, words.indices.to_numpy().astype(np.int64))
        n = np.cumsum(pc.list_value_length(split).to_numpy())
        return out, np.where(n > 0, word_ends[np.maximum(n, 1) - 1], 0) if len(word_ends) else np.zeros(len(n), np.int64)

    def encode(self, texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each block of texts of about ``size`` bytes (null: empty): all ids, and where each text's ids end."""
        for block in blocks(pc.fill_null(texts, ""), size):
            yield self._block(block)

    def each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for flat, ends in self.encode(texts):
            start = 0
            for end in ends.tolist():
                yield flat[start:end]
                start = end


def byte_letters() -> dict[int, str]:
    """Byte-level BPE writes a byte as a letter: printable ones as themselves, the others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, free = {}, 256
    for b in range(256):
        letters[b] = chr(b if b in shown else free)
        free += b not in shown
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}


@functools.cache
def encoder(name: str = DEFAULT_TOKENIZER) -> TextEncoder:
    """The worker's encoder; it and its pieces live as long as the worker."""
    return TextEncoder(name)
