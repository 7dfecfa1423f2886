"""Quality rules as a bitmask ledger.

Every rule is measured once for each document, with no regard to any policy; the ledger stores the
measurements and one bit for each rule that fails. A policy is a version and a set of rules: it keeps
a document if none of its bits is set. Verdicts and ablations of any policy come from the ledger by
bitwise operations, without the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.shared import materialize, run_folder
from kpiloom.llm.tokens import blocks

WINDOW_WORDS = 8
#: White space between words, and symbols.
_SPACE, _SYMBOLS = b"\t\n\x0b\x0c\r ", b"#*$%&|<>"
_NOT_COUNTED = _SPACE + bytes(range(0x80, 0xC0))  # a code point is counted by its first byte

#: Rules in the order of their bits: name -> the condition on the measurements under which a document fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "2 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
}
#: Versioned policies: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_words"),
    "clean-1": ("few_words", "repeated_words", "many_symbols", "repeated_lines", "word_length"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeat_words(texts: pa.Array, window: int = WINDOW_WORDS) -> np.ndarray:
    """Words of each text that lie in a run of ``window`` words found at least twice in it.

    Equal runs get equal numbers by doubling: runs of one word, of two, of four, ... up to the window."""
    split = pc.ascii_split_whitespace(texts)
    lengths = pc.list_value_length(split).to_numpy()
    doc = np.repeat(np.arange(len(texts)), lengths)
    coded = split.flatten().dictionary_encode()
    real = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)  # the kernel has empty words at the ends
    code = coded.indices.to_numpy().astype(np.int64)
    if len(code):
        doc, code = doc[real[code]], code[real[code]]
    n = np.bincount(doc, minlength=len(texts))
    out = np.zeros(len(texts), np.int64)
    if len(code) < window:
        return out
    run, size = np.unique(doc * (int(code.max()) + 1) + code, return_inverse=True)[1], 1
    while size < window:
        step = min(size, window - size)
        run = run[:len(run) - step] * (int(run.max()) + 1) + run[step:]
        run, size = np.unique(run, return_inverse=True)[1], size + step
    inside = doc[:len(run)] == doc[window - 1:]  # a run of one text's words holds that text's number
    twice = inside & (np.bincount(run[inside], minlength=int(run.max()) + 1)[run] > 1)
    cover = np.zeros(len(code) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    covered = np.cumsum(cover[:-1]) > 0
    assert len(covered) == n.sum()
    return np.bincount(doc[covered], minlength=len(texts)).astype(np.int64)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start = 0
        for block in blocks(pc.fill_null(batch.column("text"), "")):
            rows = []
            for raw in block.cast(pa.binary()).to_pylist():
                lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
                rows.append((len(raw.split()), len(raw.translate(None, _NOT_COUNTED)),
                             len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines), len(lines) - len(set(lines))))
            columns = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(start, len(block)), *(pa.array(c) for c in columns),
                 pa.array(repeat_words(block))], names=["doc_id", *MEASURES])
            start += len(block)


def bits(rules: tuple[str, ...]) -> int:
    """The mask of a set of rules."""
    return sum(1 << i for i, name in enumerate(RULES) if name in rules)


def ledger(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, the measurements, and
    failures (bit i: rule i fails). Null text has no words. A null doc_id and repeated rows are kept; an empty
    table gives no rows. No shuffle; a task holds one block of texts."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    measured = docs.select("doc_id", "text").mapInArrow(
        _measure, f"doc_id {id_type}, " + ", ".join(f"{m} long" for m in MEASURES))
    mask = F.lit(0).cast("long")
    for i, fails in enumerate(RULES.values()):
        mask = mask.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failures", mask)


def stored(docs: DataFrame) -> DataFrame:
    """The ledger of ``docs``, written once to the shared folder and read back: verdicts and ablations of any
    policy come from it, and no text is measured again."""
    return materialize(ledger(docs), f"{run_folder(docs.sparkSession, 'quality')}/ledger")


def keeps(policy: str) -> Column:
    """Verdict of a policy over the ledger."""
    return F.col("failures").bitwiseAND(F.lit(bits(POLICIES[policy]))) == 0


def ablations(entries: DataFrame, policy: str) -> DataFrame:
    """One row per rule of a policy: rule, n_failed, n_only (rejected by this rule alone, so kept without it),
    n_rejected (by the policy). One aggregate over the masks, of which there are at most 2^rules."""
    mask = F.col("failures").bitwiseAND(F.lit(bits(POLICIES[policy])))
    masks = entries.groupBy(mask.alias("mask")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bits((r,))).alias("bit")) for r in POLICIES[policy]]))
    each = masks.select("mask", "n", rules.alias("r"))
    return each.groupBy("r.rule").agg(
        F.sum(F.when(F.col("mask").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("mask") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("mask") != 0, F.col("n")).otherwise(0)).alias("n_rejected"))
