"""Words and runs of words of string arrays, by Arrow's kernels."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What separates the words of the contracts (the complements of their word classes, after A-Z are lower-cased).
SPACES = r"[\x20\x09-\x0D]+"
NOT_LETTERS_OR_DIGITS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def coded_words(texts: pa.Array, separators: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(text, code, words): the words of all texts in order, each as its text's place and its place in ``words``,
    which holds every word once, as UTF-8. A-Z are lower-cased; a null text has none."""
    split = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=separators)
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    coded = pc.list_flatten(split).dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    if b"" in words:  # the kernel gives an empty word where a text starts or ends with a separator
        real = code != words.index(b"")
        text, code = text[real], code[real]
    return text, code, words


def run_crcs(texts: pa.Array, separators: str, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each run length from 1 to ``longest``: (text, crc) of every run of so many consecutive words of a text,
    where crc is the unsigned CRC-32 of the words joined by one blank.

    A run is the pair of the run without its last word and that word: two shifted columns of codes. A CRC is
    carried on from the shorter run's, once for each distinct pair."""
    text, code, words = coded_words(texts, separators)
    crcs = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    out, run, run_crc = [(text, crcs[code])], code, crcs
    for n in range(2, longest + 1):
        inside = text[:max(0, len(text) - n + 1)] == text[n - 1:]
        pairs = run[:len(inside)][inside] * max(1, len(words)) + code[n - 1:][inside]
        distinct, short = np.unique(pairs, return_inverse=True)
        longer = (zlib.crc32(b" " + words[p % len(words)], int(run_crc[p // len(words)])) for p in distinct.tolist())
        run_crc = np.fromiter(longer, np.uint32, len(distinct))
        run = np.zeros(len(inside), np.int64)
        run[inside] = short
        out.append((text[:len(inside)][inside], run_crc[short]))
    return out
