"""Toxicity: a bidirectional gated recurrent network with attention pooling, written in numpy.

A word enters as a learned vector of its hash slot beside the mean of the vectors of its character
n-grams. Text is laid out in blocks of ``STRIDE`` words; a window is two neighbouring blocks, so
windows overlap by half and cover every word. Two gated recurrent passes, one per direction,
read a window; attention pools their states into one logit. The score of a text is the calibrated
largest logit of its windows. Labels belong to whole texts, so training follows the window that
decides a text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

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
    least_hashes,
    map_texts,
    sample_rows,
    word_hashes,
)

STRIDE = 12
STEPS = 2 * STRIDE
HIDDEN = 8
WORD_BITS, CHAR_BITS = 18, 16
CHAR_SIZES = (3, 4, 5)
WORD_DIM, CHAR_DIM = 6, 6
SAMPLE = 2400  # labelled rows the network is trained and calibrated on, at most
ROUNDS = 60
DECAY = 1e-3
SEEN = 3  # training rows that must hold a slot before it gets a vector of its own
PARTS = 3  # networks that each leave out one part of the rows, for the calibration
THRESHOLD = 0.7
SLICE = 1 << 20
CHUNK = 8192  # windows in one pass
SHUT = 30.0  # update gate of padding: the state passes unchanged


@dataclass
class ToxicityModel:
    """Parameters by name, and the calibration; empty parameters score every text ``base``."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    slope: float = 1.0
    offset: float = 0.0
    base: float = 0.0


@dataclass
class Laid:
    """Texts as blocks: the word per place (-1 padding), blocks x STRIDE, and the rows' first blocks."""

    places: np.ndarray
    starts: np.ndarray  # rows + 1
    slots: np.ndarray  # hash slot per distinct word
    gram_word: np.ndarray
    gram_slot: np.ndarray

    @property
    def window_rows(self) -> np.ndarray:
        """The row of every window; the last block of a row starts none (-1)."""
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        rows[self.starts[1:] - 1] = -1
        return rows[:-1]


def lay(texts: pa.Array) -> Laid:
    """Lower-cases, strips marks around words, and lays words out in blocks, two per row at least."""
    offsets, codes, words = coded_words(texts)
    plain = pc.utf8_lower(pc.utf8_trim(words, "!\"'()*,-.:;?[]_{}#$%&|<>"))
    coded = plain.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)[codes]
    counts = np.diff(offsets)
    blocks = np.maximum(-(-counts // STRIDE), 2)
    starts = np.concatenate([[0], np.cumsum(blocks)])
    places = np.full(starts[-1] * STRIDE, -1, np.int64)
    rows = np.repeat(np.arange(len(counts)), counts)
    places[np.arange(len(codes)) - offsets[rows] + starts[rows] * STRIDE] = codes
    words = coded.dictionary
    slots = (word_hashes(words) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    gram_word, gram_slot = char_grams(words, CHAR_SIZES, CHAR_BITS)
    return Laid(places.reshape(-1, STRIDE), starts, slots, gram_word, gram_slot)


def word_inputs(laid: Laid, p: dict[str, np.ndarray]) -> np.ndarray:
    """Vectors of the distinct words: hash slot vector, mean n-gram vector."""
    n = len(laid.slots)
    counts = np.maximum(np.bincount(laid.gram_word, minlength=n), 1)
    chars = np.empty((n, CHAR_DIM), np.float32)
    for k in range(CHAR_DIM):
        own = np.bincount(laid.gram_word, weights=p["chars"][laid.gram_slot, k], minlength=n)
        chars[:, k] = own / counts
    return np.hstack([p["words"][laid.slots], chars]).astype(np.float32)


def gate_inputs(laid: Laid, p: dict[str, np.ndarray]) -> np.ndarray:
    """Gate inputs of the distinct words, both directions, by column; padding is the last word."""
    table = word_inputs(laid, p) @ p["in"] + p["bias"]
    shut = np.zeros((1, 6 * HIDDEN), np.float32)
    shut[0, :HIDDEN] = shut[0, 3 * HIDDEN : 4 * HIDDEN] = SHUT
    return np.ascontiguousarray(np.vstack([table, shut]).T)


def projected(places: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Gate inputs of both directions at every place: 2 x (3 HIDDEN) x STRIDE x blocks."""
    return np.take(table, places.T, axis=1).reshape(2, 3 * HIDDEN, STRIDE, -1)


def _gate(x: np.ndarray) -> np.ndarray:
    """Logistic function of single-precision values, by the hyperbolic tangent."""
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


def states(inputs: np.ndarray, p: dict[str, np.ndarray], trace: list | None = None) -> np.ndarray:
    """States of both directions after every step of all windows: STEPS x 2 HIDDEN x windows."""
    h, n = HIDDEN, inputs.shape[-1] - 1
    out = np.empty((STEPS, 2 * h, n), np.float32)
    for d in range(2):
        own, u = inputs[d], p["again"][d].T
        state = np.zeros((h, n), np.float32)
        for step in range(STEPS) if d == 0 else range(STEPS - 1, -1, -1):
            x = own[:, step % STRIDE, (1 if step >= STRIDE else 0) :][:, :n]
            g = u @ state
            zr = _gate(x[: 2 * h] + g[: 2 * h])
            z, r = zr[:h], zr[h:]
            new = np.tanh(x[2 * h :] + r * g[2 * h :])
            if trace is not None:
                trace.append((d, step, state, z, r, new, g[2 * h :]))
            state = new + z * (state - new)
            out[step, d * h : (d + 1) * h] = state
    return out


def _present(places: np.ndarray) -> np.ndarray:
    """True where a step of a window holds a word: STEPS x windows."""
    real = (places >= 0).T
    return np.vstack([real[:, :-1], real[:, 1:]])


def logits(laid: Laid, p: dict[str, np.ndarray]) -> np.ndarray:
    """One logit per window, a bounded number of windows at a time."""
    table = gate_inputs(laid, p)
    parts = [
        _window_logits(laid.places[a : a + CHUNK + 1], table, p)
        for a in range(0, len(laid.places) - 1, CHUNK)
    ]
    return np.concatenate(parts) if parts else np.empty(0, np.float32)


def _window_logits(places: np.ndarray, table: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """Logits of neighbouring windows: attention over the steps that hold a word."""
    out = states(projected(places, table), p)
    weight = np.empty((STEPS, out.shape[2]), np.float32)
    value = np.empty_like(weight)
    for step in range(STEPS):
        weight[step] = p["look"] @ np.tanh(p["view"] @ out[step])
        value[step] = p["out"] @ out[step]
    weight[~_present(places)] = -1e9
    weight -= weight.max(axis=0)
    weight = np.exp(weight)
    return (weight * value).sum(axis=0) / weight.sum(axis=0) + p["level"][0]


def row_logits(laid: Laid, p: dict[str, np.ndarray]) -> np.ndarray:
    """The largest window logit of every row."""
    if not len(laid.starts) - 1:
        return np.empty(0)
    own, rows = logits(laid, p), laid.window_rows
    best = np.full(len(laid.starts) - 1, -np.inf)
    np.maximum.at(best, rows[rows >= 0], own[rows >= 0])
    return best


def _picked(laid: Laid, windows: np.ndarray) -> Laid:
    """The chosen windows alone, as rows of two blocks, with the words they hold."""
    places = laid.places[np.stack([windows, windows + 1], axis=1).ravel()]
    used = np.zeros(len(laid.slots) + 1, bool)
    used[places] = True  # padding marks the last entry
    used[-1] = False
    number = np.cumsum(used) - 1
    number[-1] = -1
    held = used[laid.gram_word]
    starts = np.arange(len(windows) + 1) * 2
    return Laid(
        number[places],
        starts,
        laid.slots[used[:-1]],
        number[laid.gram_word[held]],
        laid.gram_slot[held],
    )


def gradients(laid: Laid, y: np.ndarray, weight: np.ndarray, p: dict[str, np.ndarray]) -> dict:
    """Gradients of the weighted logistic loss, one label per row of two blocks."""
    h = HIDDEN
    trace: list = []
    inputs = projected(laid.places, gate_inputs(laid, p))
    out = states(inputs, p, trace)
    real = _present(laid.places)
    use = np.arange(0, out.shape[2], 2)  # windows of two blocks of the same row
    seen = np.tanh(np.einsum("ah,thn->tan", p["view"], out[:, :, use]))
    a = np.einsum("a,tan->tn", p["look"], seen)
    a[~real[:, use]] = -1e9
    a = np.exp(a - a.max(axis=0))
    a /= a.sum(axis=0)
    value = np.einsum("h,thn->tn", p["out"], out[:, :, use])
    logit = (a * value).sum(axis=0) + p["level"][0]
    error = ((linear.sigmoid(logit) - y) * weight).astype(np.float32)
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    grads["level"][0] = error.sum()
    pooled = np.einsum("tn,thn->hn", a, out[:, :, use])
    grads["out"] = pooled @ error
    d_value = a * error
    d_a = a * (value - (a * value).sum(axis=0)) * error
    d_seen = p["look"][None, :, None] * d_a[:, None, :] * (1 - seen**2)
    grads["look"] = np.einsum("tn,tan->a", d_a, seen)
    grads["view"] = np.einsum("tan,thn->ah", d_seen, out[:, :, use])
    d_out = np.zeros_like(out)
    d_out[:, :, use] = p["out"][None, :, None] * d_value[:, None, :] + np.einsum(
        "ah,tan->thn", p["view"], d_seen
    )
    d_in = np.zeros((2, 3 * h, STRIDE, inputs.shape[-1]), np.float32)
    carried = np.zeros((h, out.shape[2]), np.float32)
    before = None
    for d, step, state, z, r, new, g in reversed(trace):
        if d != before:
            carried, before = np.zeros_like(carried), d
        total = carried + d_out[step, d * h : (d + 1) * h]
        d_new = total * (1 - z) * (1 - new**2)
        d_z = total * (state - new) * z * (1 - z)
        d_r = d_new * g * r * (1 - r)
        gates = np.vstack([d_z, d_r, d_new])
        back = np.vstack([d_z, d_r, d_new * r])
        grads["again"][d] += state @ back.T
        carried = total * z + p["again"][d] @ back
        at = 1 if step >= STRIDE else 0
        d_in[d, :, step % STRIDE, at : at + out.shape[2]] += gates
    n_words = len(laid.slots)
    flat = d_in.reshape(6 * h, -1)
    word = laid.places.T.ravel()
    kept = word >= 0
    table = np.stack([np.bincount(word[kept], weights=row[kept], minlength=n_words) for row in flat], axis=1)
    x = word_inputs(laid, p)
    grads["in"] = (x.T @ table).astype(np.float32)
    grads["bias"] = table.sum(axis=0).astype(np.float32)
    d_x = table @ p["in"].T
    used = np.flatnonzero(np.abs(d_x).sum(axis=1) > 0)
    np.add.at(grads["words"], laid.slots[used], d_x[used, :WORD_DIM])
    counts = np.maximum(np.bincount(laid.gram_word, minlength=n_words), 1)
    share = (d_x[:, WORD_DIM:] / counts[:, None])[laid.gram_word]
    for k in range(CHAR_DIM):
        own = np.bincount(laid.gram_slot, weights=share[:, k], minlength=1 << CHAR_BITS)
        grads["chars"][:, k] = own
    return grads


def start(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    h = HIDDEN
    bias = np.zeros(6 * h, np.float32)
    return {
        "chars": normal(0.3, 1 << CHAR_BITS, CHAR_DIM),
        "in": normal(0.5, WORD_DIM + CHAR_DIM, 6 * h),
        "bias": bias,
        "again": normal(0.3, 2, h, 3 * h),
        "view": normal(0.3, h, 2 * h),
        "look": normal(0.3, h),
        "out": normal(0.5, 2 * h),
        "level": np.zeros(1, np.float32),
    }


def _odds(toxic: np.ndarray, rows: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of slots as a warm start, and which slots enough rows hold."""
    clean = rows - toxic
    odds = np.log((toxic + 1) / (y.sum() + 2)) - np.log((clean + 1) / (len(y) - y.sum() + 2))
    seen = rows >= SEEN
    return np.where(seen, odds / 2, 0).astype(np.float32), seen


def _warm_start(laid: Laid, y: np.ndarray):
    """Evidence of word slots and of n-gram slots, from the rows that hold them, row by row."""
    order = np.argsort(laid.gram_word, kind="stable")
    grams = laid.gram_slot[order]
    ends = np.searchsorted(laid.gram_word[order], np.arange(len(laid.slots) + 1))
    words, chars = np.zeros((2, 1 << WORD_BITS)), np.zeros((2, 1 << CHAR_BITS))
    for row, toxic in enumerate(y):
        places = laid.places[laid.starts[row] : laid.starts[row + 1]]
        held = np.unique(places[places >= 0])
        slot = np.unique(laid.slots[held])
        gram = np.unique(np.concatenate([grams[ends[w] : ends[w + 1]] for w in held] or [slot[:0]]))
        for counts, own in ((words, slot), (chars, gram)):
            counts[1, own] += 1
            counts[0, own] += toxic
    return _odds(*words, y), _odds(*chars, y)


def train(
    texts: Sequence[str],
    y: np.ndarray,
    share: float | None = None,
    rounds: int = ROUNDS,
    seed: int = 1,
) -> ToxicityModel:
    """Trains a network on all texts and calibrates it on logits of texts that a network has not seen.

    ``PARTS`` more networks each leave out a part of the texts, by position, and score it. The slope is fitted on these
    scores of all texts, and the offset gives ``THRESHOLD`` to the logit that parts them best. ``share`` is the share of toxic rows where the texts were drawn from,
    if they are no fair draw.
    """
    part = np.arange(len(y)) % PARTS
    unseen = np.empty(len(y))
    for i in range(PARTS):
        known, rest = part != i, part == i
        p = network([t for t, k in zip(texts, known) if k], y[known], rounds, seed + 1 + i)
        unseen[rest] = row_logits(lay(pa.array([t for t, r in zip(texts, rest) if r])), p)
    slope, _ = linear.calibrate(unseen, y)
    cut = deciding_logit(unseen, y, float(y.mean()) if share is None else share)
    offset = np.log(THRESHOLD / (1 - THRESHOLD)) - slope * cut
    return ToxicityModel(network(texts, y, rounds, seed), slope, offset)


def deciding_logit(logit: np.ndarray, y: np.ndarray, share: float) -> float:
    """The logit that parts the classes with the best harmonic mean of precision and recall, where ``share``
    of all rows are toxic; halfway between two neighbouring values."""
    order = np.argsort(-logit, kind="stable")
    ranked, toxic = logit[order], y[order] > 0
    clean_weight = (1 - share) / share * y.sum() / (len(y) - y.sum())
    hits, flagged = np.cumsum(toxic), np.cumsum(np.where(toxic, 1.0, clean_weight))
    f1 = 2 * hits / (flagged + y.sum())
    f1[:-1][ranked[:-1] == ranked[1:]] = -1  # equal logits stay together
    best = int(f1.argmax())
    return float(ranked[best] if best + 1 == len(ranked) else (ranked[best] + ranked[best + 1]) / 2)


def network(texts: Sequence[str], y: np.ndarray, rounds: int = ROUNDS, seed: int = 1) -> dict[str, np.ndarray]:
    """Parameters trained on the texts; all toxic ones take part, each by the window that decides it."""
    laid = lay(pa.array(list(texts)))
    own = y.astype(np.float32)
    rng = np.random.default_rng(seed)
    p = start(seed)
    (odds, seen), (char_odds, char_seen) = _warm_start(laid, own)
    p["chars"][~char_seen] = 0
    p["chars"][:, 0] = char_odds
    number = np.cumsum(seen) * seen  # slots without a vector of their own share row 0, all zero
    laid.slots = number[laid.slots]
    p["words"] = np.zeros((int(number.max()) + 1, WORD_DIM), np.float32)
    p["words"][number[seen], 0] = odds[seen]
    first, last = laid.starts[:-1], laid.starts[1:] - 1  # a row's windows
    toxic, clean = np.flatnonzero(own > 0), np.flatnonzero(own == 0)
    best = np.zeros(len(own), np.int64)

    def windows(step: int) -> tuple[np.ndarray, np.ndarray]:
        if step % 4 == 1:  # which window decides a text, under the present parameters; at first the warm start
            odds = logits(laid, p) if step > 1 else p["words"][laid.slots, 0][laid.places[:-1]].max(axis=1)
            rows = laid.window_rows
            order = np.lexsort((odds, rows))
            ends = np.searchsorted(rows[order], np.arange(len(own)), side="right") - 1
            best[:] = order[ends]
        few = rng.choice(clean, min(len(clean), 300), replace=False)
        more = rng.choice(clean, min(len(clean), 300), replace=False)
        some = rng.choice(toxic, min(len(toxic), 300), replace=False)
        drawn = first[more] + (rng.random(len(more)) * (last[more] - first[more])).astype(np.int64)
        chosen = np.concatenate([best[some], best[few], drawn])
        return chosen, np.concatenate([np.ones(len(some)), np.zeros(len(few) + len(more))])

    def gradient(step: int) -> dict[str, np.ndarray]:
        chosen, target = windows(step)
        ones = target.sum()
        weight = np.where(target > 0, 0.5 / ones, 0.5 / (len(target) - ones))
        grads = gradients(_picked(laid, chosen), target, weight, p)
        grads["words"] += DECAY * p["words"]
        grads["words"][0] = 0
        grads["chars"][~char_seen] = 0
        grads["chars"] += DECAY * p["chars"]
        return grads

    linear.adam(p, gradient, rounds, 0.02)
    p["words"] = p["words"][number]
    return p


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample: int = SAMPLE,
) -> ToxicityModel:
    """Trains on at most ``sample`` labelled rows where ``learn`` holds, toxic ones up to a third.

    Rows without a label or text are not used. Without ten rows of either class there is no
    network: every text scores the share of toxic rows (0 without labels).
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & learn).select(
        key, F.col(label).cast("int").alias("__y")
    )
    wanted = F.when(F.col("__y") == 1, sample // 3).otherwise(sample)
    chosen = (
        least_hashes(known, key, "__y", wanted, 1)
        .orderBy("__rank", F.desc("__y"))
        .select(key, "__y")
    )
    rows = [r for r in sample_rows(docs, chosen, key, [text], sample) if r[text]]
    y = np.array([r["__y"] for r in rows])
    if not len(y) or min(y.sum(), len(y) - y.sum()) < 10:
        return ToxicityModel(base=float(y.mean()) if len(y) else 0.0)
    share = known.agg(F.avg("__y")).first()[0]
    return train([r[text] for r in rows], y, share)


def score_toxicity(
    docs: DataFrame,
    model: ToxicityModel,
    key: str = "doc_id",
    text: str = "text",
    keep: Sequence[str] = (),
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Scores all overlapping windows of every whole text: ``key``, ``keep``, score, predicted.

    A null or empty text is one window without words; its score is that of the network's level. Texts are whole,
    however long; a null key is kept.
    Repeated rows give repeated results, an empty table an empty one. Columns of ``keep`` named like
    a new column are dropped.
    """

    def work():
        def compute(texts: pa.Array):
            if not model.p:
                score = np.full(len(texts), model.base)
            else:
                best = np.concatenate(
                    [row_logits(lay(part), model.p) for part in _parts(texts)] or [np.empty(0)]
                )
                score = linear.sigmoid(model.slope * best + model.offset)
            return score, (score >= threshold).astype(np.int32)

        return compute

    added = [("score", T.DoubleType()), ("predicted", T.IntegerType())]
    return map_texts(docs, key, text, added, work, keep)


def _parts(texts: pa.Array, limit: int = SLICE):
    """Row ranges with about ``limit`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield texts.slice(a, b - a)
