"""Quality rules: fixed counts, and a calibrated logistic model over hashed n-grams.

The model reads the shares of hashed words, word pairs and character n-grams. It is fitted on a
bounded sample of labelled rows, calibrated on other labelled rows, and scored in Arrow batches
against a fixed threshold. Counts cover whole texts and are exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm import linear
from panelcast.llm.text import (
    char_grams,
    coded_words,
    filled,
    map_texts,
    mixed,
    row_of,
    sample_rows,
    sums_by,
    word_hashes,
)

SYMBOLS = "#*$%&|<>"  # fixed by the rule
WINDOW = 8
WORD_BITS, PAIR_BITS, CHAR_BITS = 11, 11, 12
CHAR_SIZES = (1, 2, 3)
SAMPLE = 3000  # labelled rows the model is fitted and calibrated on, at most
KEEP_FROM = 0.35  # least probability of good quality


@dataclass(frozen=True)
class QualityModel:
    """Weights by slot and the calibration; ``None`` weights reject nothing."""

    words: np.ndarray | None = None
    pairs: np.ndarray | None = None
    chars: np.ndarray | None = None
    slope: float = 0.0
    offset: float = 0.0


def _slots(texts: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, int]], tuple]:
    """Row offsets; (row, slot, bits) per word and pair; the character n-grams of distinct words."""
    offsets, codes, words = coded_words(texts)
    rows = row_of(offsets)
    hashes = word_hashes(words)
    single = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)[codes]
    first, second = hashes[codes[:-1]], hashes[codes[1:]]
    pair = (mixed(first * np.uint64(3) + second) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
    pair[first == second] = 0  # a repeated word is one feature whatever the word
    inside = rows[:-1] == rows[1:] if len(rows) else np.empty(0, bool)
    grams = char_grams(words, CHAR_SIZES, CHAR_BITS)
    parts = [(rows, single, WORD_BITS), (rows[:-1][inside], pair[inside], PAIR_BITS)]
    return offsets, parts, (rows, codes, grams, len(words))


def _features(texts: pa.Array) -> np.ndarray:
    """Shares of all slots, row by row; for the bounded sample."""
    offsets, parts, (rows, codes, (owner, slot), _) = _slots(texts)
    n = len(offsets) - 1
    order = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[order], np.arange(codes.max() + 2 if len(codes) else 1))
    counts = np.diff(starts)[codes]
    picked = np.repeat(starts[codes], counts) + _within(counts)
    parts = [*parts, (np.repeat(rows, counts), slot[order][picked], CHAR_BITS)]
    blocks = []
    for row, s, bits in parts:
        block = np.bincount((row << bits) + s, minlength=n << bits).reshape(n, -1)
        blocks.append((block / np.maximum(block.sum(axis=1, keepdims=True), 1)).astype(np.float32))
    return np.hstack(blocks)


def _table(texts: Sequence[str], step: int = 200) -> np.ndarray:
    """Features of the sample, a few texts at a time."""
    x = np.empty((len(texts), (1 << WORD_BITS) + (1 << PAIR_BITS) + (1 << CHAR_BITS)), np.float32)
    for i in range(0, len(texts), step):
        x[i : i + step] = _features(pa.array(texts[i : i + step]))
    return x


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... inside every run of the given lengths."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample: int = SAMPLE,
) -> QualityModel:
    """Fits and calibrates the model on at most ``sample`` labelled rows, picked by hash.

    Rows without a label or text are not used. With fewer than ten rows of a class there is no
    model, and only the fixed rules decide.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    known = known.select(key, F.col(label).cast("int").alias("__y"))
    hashed, total = F.xxhash64(key, F.lit(9)), known.count()
    low = F.pmod(hashed, F.lit(1 << 30)) < int((1 << 30) * min(1.0, 2 * (sample + 50) / max(total, 1)))
    chosen = known.filter(low).orderBy(hashed, key)
    rows = [r for r in sample_rows(docs, chosen, key, [text], sample) if r[text]]
    y = np.array([r["__y"] for r in rows])
    if min(y.sum(), len(y) - y.sum()) < 10:
        return QualityModel()
    fitting = np.arange(len(y)) % 4 != 0
    if min(y[fitting].sum(), (1 - y[fitting]).sum()) < 5 or len(np.unique(y[~fitting])) < 2:
        return QualityModel()
    texts = [r[text] for r in rows]
    del rows
    w, b = linear.fit_logistic(_table([t for t, f in zip(texts, fitting) if f]), y[fitting])
    margin = (_table([t for t, f in zip(texts, fitting) if not f]) @ w + b)[:, 0]
    slope, offset = linear.calibrate(margin, y[~fitting])
    ends = np.cumsum([1 << WORD_BITS, 1 << PAIR_BITS])
    words, pairs, chars = np.split(w[:, 0], ends)
    return QualityModel(words, pairs, chars, slope, offset + slope * float(b[0]))


def _probability(texts: pa.Array, model: QualityModel) -> np.ndarray:
    offsets, parts, (rows, codes, (owner, slot), n_words) = _slots(texts)
    n = len(offsets) - 1
    if model.words is None:
        return np.ones(n)
    total = np.zeros(n)
    for (row, s, _), w in zip(parts, (model.words, model.pairs)):
        total += sums_by(row, w[s], n) / np.maximum(np.bincount(row, minlength=n), 1)
    sums = np.bincount(owner, weights=model.chars[slot], minlength=n_words)
    counts = np.bincount(owner, minlength=n_words)
    total += sums_by(rows, sums[codes], n) / np.maximum(sums_by(rows, counts[codes], n), 1)
    return linear.sigmoid(model.slope * total + model.offset)


def repeated_words(offsets: np.ndarray, codes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words inside windows of ``window`` words that stand twice or more in the row, per row; exact."""
    n_rows = len(offsets) - 1
    result = np.zeros(n_rows, np.int64)
    if len(codes) < window:
        return result
    rows = row_of(offsets)
    count = len(codes) - window + 1
    h = rows[:count].astype(np.uint64)
    for k in range(window):
        h = mixed(h + codes[k : k + count].astype(np.uint64))
    inside = rows[:count] == rows[window - 1 :]
    ordered = np.sort(h[inside])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return result
    place = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    at = np.flatnonzero(inside & (twice[place] == h))
    # equal hashes may still be different words: number the windows by what they hold
    number = rows[at].astype(np.int64)
    width = int(codes.max()) + 1
    for k in range(window):
        _, number = np.unique(number * width + codes[at + k], return_inverse=True)
    at = at[np.bincount(number)[number] > 1]
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    covered = np.cumsum(change[:-1]) > 0
    return np.bincount(rows, weights=covered, minlength=n_rows).astype(np.int64)


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of the row, per row."""
    lists = pc.split_pattern(filled(texts), "\n")
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)])
    coded = pc.list_flatten(lists).dictionary_encode()
    full = pc.not_equal(pc.ascii_trim_whitespace(coded.dictionary), "").to_numpy(zero_copy_only=False)
    codes, rows, n = coded.indices.to_numpy(), row_of(offsets), len(offsets) - 1
    used = full[codes]
    pairs = rows[used] * len(full) + codes[used]
    different = np.bincount(np.unique(pairs) // max(len(full), 1), minlength=n)
    return np.bincount(rows[used], minlength=n) - different


def symbols(texts: pa.Array) -> np.ndarray:
    """Characters of ``SYMBOLS``, per row."""
    texts = filled(texts)
    if texts.offset:
        texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    hit = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])[data]
    sums = np.concatenate([[0], np.cumsum(hit)])
    return np.diff(sums[offsets - offsets[0]])


def quality_rules(
    docs: DataFrame,
    model: QualityModel,
    key: str = "doc_id",
    text: str = "text",
    keep: Sequence[str] = (),
    keep_from: float = KEEP_FROM,
) -> DataFrame:
    """Counts, fixed rules and the verdict of the model for every whole text.

    Returns ``key``, ``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed (fewer than 20 words, or over 30 % of the words in repeated 8-word windows),
    quality (calibrated probability) and kept (not base_failed and quality >= ``keep_from``). A null
    text has no words and fails. Texts are whole, however long; a null key is kept. Repeated rows give repeated results, an empty table an empty
    one. Columns of ``keep`` named like a new column are dropped.
    """

    def work():
        def compute(texts: pa.Array):
            offsets, codes, words = coded_words(texts)
            n_words = np.diff(offsets)
            lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
            rows = row_of(offsets)
            chars = np.bincount(rows, weights=lengths[codes], minlength=len(n_words))
            repeats = repeated_words(offsets, codes)
            failed = (n_words < 20) | (100 * repeats > 30 * n_words)
            quality = _probability(texts, model)
            return (
                n_words,
                chars.astype(np.int64),
                symbols(texts).astype(np.int64),
                duplicate_lines(texts).astype(np.int64),
                repeats,
                failed,
                quality,
                ~failed & (quality >= keep_from),
            )

        return compute

    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    added = [(c, T.LongType()) for c in counts]
    added += [("base_failed", T.BooleanType()), ("quality", T.DoubleType()), ("kept", T.BooleanType())]
    return map_texts(docs, key, text, added, work, keep)
