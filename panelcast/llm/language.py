"""Language identification with error-correcting output codes.

Every language has a codeword. One logistic model per bit, over shares of hashed character
n-grams, predicts the bit. Decoding adds up the logistic losses of a codeword's bits, each weighted
by how well its model separates held-in rows, and takes the codeword with the least loss. A small
distance to the second one is flagged.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm import linear
from panelcast.llm.text import (
    char_grams,
    coded_words,
    filled,
    least_hashes,
    map_texts,
    row_of,
    sample_rows,
)

BITS = 12
SIZES = (1, 2, 3)
SAMPLE = 2400  # rows the models are fitted on, at most
AMBIGUOUS = 0.2  # share of the loss range below which the choice is flagged
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...] = ()
    codes: np.ndarray | None = None  # languages x bits, -1 or 1
    weights: np.ndarray | None = None  # slots x bits
    offsets: np.ndarray | None = None
    bit_weights: np.ndarray | None = None
    sharpness: float = 1.0


def codewords(n: int, seed: int = 10) -> np.ndarray:
    """A codeword of -1 and 1 per language; no column is constant or repeats another.

    Up to six languages get all different splits; more get the random code with the largest least
    distance among a hundred draws.
    """
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        columns = [[1 if k == 0 or (c >> (k - 1)) & 1 else -1 for k in range(n)] for c in range(2 ** (n - 1) - 1)]
        return np.array(columns).T
    rng = np.random.default_rng(seed)
    width = int(np.ceil(10 * np.log2(n)))
    best, distance = None, -1
    for _ in range(100):
        code = rng.choice([-1, 1], size=(n, width))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (code[:, None, :] != code[None, :, :]).sum(axis=2) + np.eye(n, dtype=int) * width
        if apart.min() > distance:
            best, distance = code, apart.min()
    return best


def _grams(texts: pa.Array):
    """Row offsets, word codes and the character n-grams of the distinct lower-cased words."""
    offsets, codes, words = coded_words(pc.utf8_lower(filled(texts)))
    return offsets, codes, char_grams(words, SIZES, BITS), len(words)


def _features(texts: pa.Array) -> np.ndarray:
    offsets, codes, (owner, slot), n_words = _grams(texts)
    n = len(offsets) - 1
    uses = np.bincount((row_of(offsets) * max(n_words, 1)) + codes, minlength=n * n_words).reshape(n, -1)
    x = np.zeros((n, 1 << BITS), np.float32)
    for row in range(n):
        used = uses[row][owner] if n_words else np.empty(0)
        x[row] = np.bincount(slot, weights=used, minlength=1 << BITS) if n_words else 0
    return x / np.maximum(x.sum(axis=1, keepdims=True), 1)


def fit_languages(
    docs: DataFrame,
    learn: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "lang",
    sample: int = SAMPLE,
) -> LanguageModel:
    """Fits the bit models on at most ``sample`` rows where ``learn`` holds and the label is set.

    Rows are picked by hash, the languages in turn, so that rare ones are not crowded out.
    """
    known = docs.filter(learn & F.col(label).isNotNull() & F.col(key).isNotNull()).select(
        key, F.col(label).alias("__y")
    )
    chosen = (
        least_hashes(known, key, "__y", sample, 10)
        .orderBy("__rank", F.xxhash64("__y"), "__y")
        .select(key, "__y")
    )
    rows = [r for r in sample_rows(docs, chosen, key, [text], sample) if r[text]]
    languages = tuple(sorted({r["__y"] for r in rows}))
    if not languages:
        return LanguageModel()
    codes = codewords(len(languages))
    which = np.searchsorted(languages, [r["__y"] for r in rows])
    x = np.vstack([_features(pa.array([r[text]])) for r in rows]).astype(np.float32)
    y = (codes[which] > 0).astype(np.float32)
    fitting = np.arange(len(rows)) % 5 != 0
    if len(languages) > 1 and len(rows) >= 50:
        w, b = linear.fit_logistic(x[fitting], y[fitting], steps=120, decay=1e-4)
    else:
        fitting[:] = False
        w, b = linear.fit_logistic(x.copy(), y, steps=120, decay=1e-4)
    margins = np.clip(x[~fitting] @ w + b, -20, 20)
    right = np.maximum(((margins > 0) == (y[~fitting] > 0)).mean(axis=0) - 0.5, 0.01)
    bit_weights = right / right.sum()
    losses = _losses(margins, codes, bit_weights)
    sharp = _sharpness(losses, which[~fitting])
    return LanguageModel(languages, codes, w, b, bit_weights, sharp)


def _losses(margins: np.ndarray, codes: np.ndarray, bit_weights: np.ndarray) -> np.ndarray:
    """Weighted logistic loss of every codeword, rows x languages."""
    each = np.logaddexp(0, -margins[:, None, :] * codes[None, :, :])
    return each @ bit_weights


def _sharpness(losses: np.ndarray, which: np.ndarray) -> float:
    """The factor on losses under which their softmax fits the held-in rows best."""
    best = (np.inf, 1.0)
    for factor in 2.0 ** np.arange(-2, 7):
        z = -factor * losses
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        cost = -np.log(np.maximum(p[np.arange(len(which)), which], 1e-6)).mean() if len(which) else 0
        best = min(best, (cost, float(factor)))
    return best[1]


def predict_languages(
    docs: DataFrame,
    model: LanguageModel,
    key: str = "doc_id",
    text: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """The language of every whole text: ``key``, ``keep``, lang_pred, score, ambiguous.

    ``und`` with score 0 for a null text, a text without a letter, or a model that learned nothing.
    Ties go to the language first in order. Texts are whole, however long; a null key is kept. Repeated rows give repeated results, an empty table an
    empty one. Columns of ``keep`` named like a new column are dropped.
    """

    def work():
        def compute(texts: pa.Array):
            n = len(texts)
            letters = pc.match_substring_regex(filled(texts), r"\p{L}").to_numpy(zero_copy_only=False)
            if not model.languages:
                return [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
            offsets, codes, (owner, slot), n_words = _grams(texts)
            rows = row_of(offsets)
            sizes = np.bincount(owner, minlength=n_words)
            total = np.maximum(np.bincount(rows, weights=sizes[codes], minlength=n), 1)
            margins = np.empty((n, model.weights.shape[1]))
            for bit in range(margins.shape[1]):
                own = np.bincount(owner, weights=model.weights[slot, bit], minlength=n_words)
                margins[:, bit] = np.bincount(rows, weights=own[codes], minlength=n) / total
            margins = np.clip(margins + model.offsets, -20, 20)
            losses = _losses(margins, model.codes, model.bit_weights)
            chosen = losses.argmin(axis=1)
            z = -model.sharpness * (losses - losses.min(axis=1, keepdims=True))
            score = 1 / np.exp(z).sum(axis=1)
            ordered = np.sort(losses, axis=1)
            second = ordered[:, min(1, ordered.shape[1] - 1)]
            close = (second - ordered[:, 0]) < AMBIGUOUS * np.maximum(ordered[:, -1] - ordered[:, 0], 1e-12)
            names = np.array(model.languages, dtype=object)[chosen]
            names[~letters] = UNKNOWN
            return pa.array(names, pa.string()), np.where(letters, score, 0.0), close | ~letters

        return compute

    added = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("ambiguous", T.BooleanType())]
    return map_texts(docs, key, text, added, work, keep)
