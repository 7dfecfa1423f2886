"""Language ID: script ranges, per-word scores, and a Viterbi path over the words.

A word is a run of letters. The script ranges of its first letter narrow the candidates to the
languages that were seen to use that script, and hashed letter n-grams score the word for these only
(for all languages, if none uses the script; such words never count as recognised).
The best path over a text's words, where every change of language costs a penalty, labels its spans;
the label of the text is the language whose spans hold most letters.

A word is recognised if some language uses its script and its score a place is no lower than halfway
from the language's level in training to a background where every hash slot is as likely. The score
of a text is the share of its visible characters in recognised words of its language, so letters of
an unknown script or language, digits and symbols all count against it.

A path without a change is the best one if no run of words gains half the penalty in another language
(a path of n other runs pays n - 1 changes at least, and one of one run is no better), which a few
prefix sums tell; only the other texts take the step-by-step path.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.tokens import blocks

#: Parameters of the model. ``SAMPLE_ROWS`` bounds the labelled rows that it is fitted on, an equal part for
#: each language.
SAMPLE_ROWS = 20_000
HASH_BITS = 16
ORDERS = (2, 3, 4)
PENALTY = 12.0
LEAST_SHARE = 0.01
_BLOCK_BYTES = 1 << 18

#: First code points of the script ranges (Unicode blocks) and the script of each.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3130, "hangul"), (0x31F0, "kana"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
)
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({name for _, name in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(name) for _, name in SCRIPTS])


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@functools.cache
def _visible() -> np.ndarray:
    """Neither blanks, control characters nor marks, which belong to the letter before them."""
    return np.fromiter((unicodedata.category(chr(c))[0] not in "MZC" for c in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def words_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters."""
    is_letter = np.concatenate(([False], _letters()[points], [False]))
    turns = np.flatnonzero(is_letter[1:] != is_letter[:-1])
    return turns[::2], turns[1::2]


def features(points: np.ndarray) -> list[np.ndarray]:
    """For each order, the hashed n-gram that ends at each letter; everything else counts as a blank. The
    place after a word's last letter has an n-gram too, which ends in the blank."""
    masked = np.where(_letters()[points], points, 0)
    padded = np.concatenate((np.zeros(max(ORDERS) - 1, np.int64), masked))
    out = []
    for order in ORDERS:
        mixed = np.full(len(points), order, np.uint64)
        for back in range(order):
            at = max(ORDERS) - 1 - back
            mixed = (mixed ^ padded[at:at + len(points)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        out.append((mixed >> np.uint64(64 - HASH_BITS)).astype(np.int64))
    return out


@dataclass
class Model:
    """``scores[order, hash, language]``: log probability; ``uses[language, script]``; ``least[language]``: the
    lowest score a place of a recognised word."""

    languages: list[str]
    scores: np.ndarray
    uses: np.ndarray
    least: np.ndarray

    def word_scores(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, languages), and whether any language uses the word's script; one that does not is far below
        those that do."""
        out = np.zeros((len(starts), len(self.languages)))
        if not len(starts):
            return out, np.zeros(0, bool)
        hashed = features(points)
        script = _SCRIPT[np.searchsorted(_STARTS, points[starts], "right") - 1]
        stops = np.minimum(ends + 1, len(points))  # with the place after the word
        for s in np.unique(script):
            some, langs = np.flatnonzero(script == s), np.flatnonzero(self.uses[:, s])
            langs = langs if len(langs) else np.arange(len(self.languages))
            if len(some) == len(starts):
                places, first, last = hashed, starts, stops
            else:
                sizes = (stops - starts)[some]
                last = np.cumsum(sizes)
                first = last - sizes
                at = np.arange(last[-1]) + np.repeat(starts[some] - first, sizes)
                places = [h[at] for h in hashed]
            table = self.scores if len(langs) == len(self.languages) else self.scores[:, :, langs]
            total = np.zeros((len(places[0]) + 1, len(langs)))
            for order, h in enumerate(places):
                total[1:] += table[order][h]
            np.cumsum(total, axis=0, out=total)
            found = (total[last] - total[first]) / len(ORDERS)
            out[some] = found.min(axis=1, keepdims=True) - 1e3
            out[some[:, None], langs] = found
        return out, self.uses.any(axis=0)[script]


def best_path(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The language of each word on the best path (ties: the earlier language, and no change)."""
    n, k = scores.shape
    lead = int(scores.sum(axis=0).argmax())
    for other in range(k):
        if other != lead:
            sums = np.concatenate(([0.0], np.cumsum(scores[:, other] - scores[:, lead])))
            if (sums - np.minimum.accumulate(sums)).max() >= penalty / 2:
                break
    else:
        return np.full(n, lead)
    # plain numbers: a step over a few languages costs less than a call into numpy
    rows = scores.tolist()
    held, came = rows[0], []
    for row in rows[1:]:
        top = max(held)
        least = top - penalty
        if min(held) >= least:
            came.append(None)
            held = [h + x for h, x in zip(held, row, strict=True)]
            continue
        lead = held.index(top)
        came.append([lead if h < least else i for i, h in enumerate(held)])
        held = [(least if h < least else h) + x for h, x in zip(held, row, strict=True)]
    at = held.index(max(held))
    path = [at]
    for step in reversed(came):
        at = at if step is None else step[at]
        path.append(at)
    return np.array(path[::-1], np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and language: how often each hashed n-gram and each script occurs."""
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        labels = iter(batch.column("lang").to_pylist())
        for text in (t for block in blocks(batch.column("text"), _BLOCK_BYTES) for t in block.to_pylist()):
            lang = next(labels)
            points = code_points(text)
            starts, ends = words_of(points)
            if not len(starts):
                continue
            edge = np.zeros(len(points) + 1, bool)
            edge[ends] = True
            keep = _letters()[points] | edge[:len(points)]
            n = grams.setdefault(lang, np.zeros((len(ORDERS), 1 << HASH_BITS), np.int64))
            for order, hashed in enumerate(features(points)):
                n[order] += np.bincount(hashed[keep], minlength=1 << HASH_BITS)
            script = _SCRIPT[np.searchsorted(_STARTS, points[starts], "right") - 1]
            scripts.setdefault(lang, np.zeros(len(_NAMES), np.int64))
            scripts[lang] += np.bincount(script, weights=ends - starts, minlength=len(_NAMES)).astype(np.int64)
    for lang, n in grams.items():
        flat = np.concatenate((n.ravel(), scripts[lang]))
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(flat[at])],
                                         names=["lang", "slot", "n"])


def train(docs: DataFrame, *, where: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on the rows of ``docs`` (doc_id, text, lang) with text and language that ``where`` holds for: about
    ``sample_rows`` of them, an equal part for each language (all of a language that has no more), chosen by a
    hash of id and text. None if there is no such row with a letter.

    What reaches the driver is a count per language and hash slot, whatever the number of rows."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = rows if where is None else rows.filter(where)
    sizes = [(r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    part = sample_rows / max(1, len(sizes))
    shares = docs.sparkSession.createDataFrame([(lang, int(min(1.0, part / n) * (1 << 30))) for lang, n in sizes],
                                               "lang string, below int")
    chosen = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id"), F.col("text")), F.lit(1 << 30)) < F.col("below")
    counts = (rows.join(F.broadcast(shares), "lang").filter(chosen).select("text", "lang")
              .mapInArrow(_count, "lang string, slot long, n long")
              .groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow())
    languages = sorted(set(counts["lang"].to_pylist()))
    if not languages:
        return None
    size = len(ORDERS) << HASH_BITS
    flat = np.zeros((len(languages), size + len(_NAMES)))
    row = np.searchsorted(np.array(languages), np.array(counts["lang"].to_pylist()))
    flat[row, counts["slot"].to_numpy()] = counts["n"].to_numpy()
    grams = flat[:, :size].reshape(len(languages), len(ORDERS), -1) + 0.1
    grams /= grams.sum(axis=2, keepdims=True)
    logs, used = np.log(grams), flat[:, size:]
    level = (grams * logs).sum(axis=2).mean(axis=1)  # the mean score a place of what was learned
    return Model(languages, np.ascontiguousarray(np.moveaxis(logs, 0, 2)).astype(np.float32), used >= LEAST_SHARE * used.sum(axis=1, keepdims=True),
                 (level - HASH_BITS * np.log(2)) / 2)


def label(text: str, model: Model, penalty: float = PENALTY) -> tuple[str, float, list[tuple[str, int, int]]]:
    """Language of a text, the share of the visible characters in its recognised words, and the labelled spans
    (language, start, end in code points of the lower-cased text). A text without letters gives ``und``; one
    without letters of a learned script the language of highest score, recognised in nothing: score 0."""
    points = code_points(text)
    starts, ends = words_of(points)
    if not len(starts):
        return "und", 0.0, []
    return _label(*model.word_scores(points, starts, ends), starts, ends, int(_visible()[points].sum()), model, penalty)


def _label(scores, narrowed, starts, ends, n_visible, model, penalty):
    path = best_path(scores, penalty)
    # letters of unknown scripts have a say only where there are no others
    weights = (ends - starts) * (narrowed if narrowed.any() else 1)
    best = int(np.bincount(path, weights=weights, minlength=len(model.languages)).argmax())
    known = narrowed & (path == best) & (scores[:, best] >= model.least[best] * (ends - starts + 1))
    cuts = np.concatenate(([0], np.flatnonzero(path[1:] != path[:-1]) + 1, [len(path)]))
    spans = [(model.languages[path[a]], int(starts[a]), int(ends[b - 1])) for a, b in zip(cuts, cuts[1:], strict=False)]
    return model.languages[best], float((ends - starts)[known].sum() / n_visible), spans


def _predict(batches: Iterator[pa.RecordBatch], model: Model | None, penalty: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, shares, spans = [], [], []
        for block in blocks(pc.fill_null(batch.column("text"), ""), _BLOCK_BYTES):
            # the block's texts stand one after another, a line feed after each
            texts = [code_points(t + "\n") for t in block.to_pylist()]
            points = np.concatenate(texts)
            starts, ends = words_of(points)
            first = np.searchsorted(starts, np.cumsum([0, *map(len, texts)]))
            scores, narrowed = (None, None) if model is None else model.word_scores(points, starts, ends)
            visible = [int(_visible()[t].sum()) for t in texts]
            for a, b, n in zip(first, first[1:], visible, strict=False):
                if a == b or model is None:
                    lang, share, found = "und", 0.0, []
                else:
                    lang, share, found = _label(scores[a:b], narrowed[a:b], starts[a:b], ends[a:b], n, model, penalty)
                langs.append(lang)
                shares.append(share)
                spans.append(len(found))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(shares, pa.float64()),
             pa.array(spans, pa.int64())], names=["doc_id", "lang_pred", "score", "n_spans"])


def predict(docs: DataFrame, model: Model | None, *, penalty: float = PENALTY) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, lang_pred, score (the share
    of the text's letters, digits and symbols in recognised words of that language), n_spans.

    Null texts and texts without a letter are ``und`` with score 0; so is every text if there was nothing to learn
    from. A text with letters always gets a learned language, with score 0 if none of its scripts was learned. A null doc_id and repeated rows are kept; an empty table gives no rows. No shuffle."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x orders x 2^16 scores
    return docs.select("doc_id", "text").mapInArrow(
        lambda b: _predict(b, shared.value, penalty), f"doc_id {id_type}, lang_pred string, score double, n_spans long")


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that the model never learns from: a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def keep_known(docs: DataFrame, model: Model | None, *, least: float = 0.3, penalty: float = PENALTY) -> DataFrame:
    """The rows of ``docs`` whose text has a language that at least ``least`` of its letters, digits and symbols are
    recognised in. Null texts, texts without a letter, and texts mostly in scripts or languages that were not
    learned or of symbols go. Without a model nothing is rejected."""
    if model is None:
        return docs
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), batch.column(at)],
                                              names=["doc_id", "text"])
            for out in _predict(iter([told]), shared.value, penalty):
                yield batch.filter(pc.and_(pc.not_equal(out["lang_pred"], "und"), pc.greater_equal(out["score"], least)))

    return docs.mapInArrow(keep, docs.schema)
