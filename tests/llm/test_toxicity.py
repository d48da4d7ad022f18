"""The toxicity network against a plain forward pass, and its held-out results on the given tables."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelcast.llm import toxicity
from panelcast.llm.text import learned_fold


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def plain_logit(places, inputs, p):
    """One window, word by word: two recurrent passes, attention over the words, one logit."""
    h, held = toxicity.HIDDEN, [w >= 0 for w in places]
    both = []
    for d in range(2):
        state, states = np.zeros(h), {}
        steps = range(len(places)) if d == 0 else range(len(places) - 1, -1, -1)
        for t in steps:
            if held[t]:
                x = (inputs[places[t]] @ p["in"] + p["bias"])[d * 3 * h : (d + 1) * 3 * h]
                g = state @ p["again"][d]
                z = np.array([sigmoid(v) for v in x[:h] + g[:h]])
                r = np.array([sigmoid(v) for v in x[h : 2 * h] + g[h : 2 * h]])
                new = np.tanh(x[2 * h :] + r * g[2 * h :])
                state = new + z * (state - new)
            states[t] = state
        both.append(states)
    out = [np.concatenate([both[0][t], both[1][t]]) for t in range(len(places))]
    if not any(held):
        return None
    look = [p["look"] @ np.tanh(p["view"] @ o) if k else -math.inf for o, k in zip(out, held)]
    weight = [math.exp(v - max(look)) for v in look]
    value = sum(w * (p["out"] @ o) for w, o in zip(weight, out)) / sum(weight)
    return value + p["level"][0]


def test_windows_equal_a_plain_forward_pass():
    rng = np.random.default_rng(3)
    words = [f"w{i}é" for i in range(40)]
    texts = [" ".join(rng.choice(words, n)) for n in (1, 5, 12, 13, 24, 25, 61, 100)]
    laid = toxicity.lay(pa.array(texts))
    p = toxicity.start(4)
    p["words"] = rng.normal(0, 0.5, (1 << toxicity.WORD_BITS, toxicity.WORD_DIM)).astype(np.float32)
    inputs = toxicity.word_inputs(laid, p)
    found = toxicity.row_logits(laid, p)
    for row in range(len(texts)):
        a, b = laid.starts[row], laid.starts[row + 1]
        windows = [laid.places[i : i + 2].ravel().tolist() for i in range(a, b - 1)]
        want = [v for w in windows if (v := plain_logit(w, inputs, p)) is not None]
        np.testing.assert_allclose(found[row], max(want), rtol=1e-4, atol=1e-4)


def rank_area(score, y):
    order = np.argsort(np.argsort(score))
    toxic = y == 1
    return (order[toxic].sum() - toxic.sum() * (toxic.sum() - 1) / 2) / (toxic.sum() * (~toxic).sum())


def test_held_out_documents_of_the_given_tables():
    """The fit sees two thirds of the labelled rows, 33 toxic ones at this size."""
    pq = pytest.importorskip("pyarrow.parquet")
    folder = "/root/testdata/sf0.01"
    docs = pq.read_table(f"{folder}/documents.parquet").to_pydict()
    text = dict(zip(docs["doc_id"], docs["text"]))
    labels = pq.read_table(f"{folder}/labels.parquet").to_pydict()
    rows = [(d, text[d], y) for d, y in zip(labels["doc_id"], labels["toxic"]) if text.get(d) and y is not None]
    rows.sort(key=lambda r: zlib.crc32(str(r[0]).encode()))
    apart = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    model = toxicity.train([t for _, t, _ in known], np.array([y for *_, y in known]))
    logit = toxicity.row_logits(toxicity.lay(pa.array([t for _, t, _ in apart])), model.p)
    score = 1 / (1 + np.exp(-(model.slope * logit + model.offset)))
    y = np.array([v for *_, v in apart])
    flagged = score >= toxicity.THRESHOLD
    assert rank_area(score, y) >= 0.85
    assert flagged[y == 1].mean() >= 0.6 and flagged[y == 0].mean() <= 0.05


def test_deciding_logit_parts_the_classes():
    logit = np.array([3.0, 2.0, 1.0, 0.0, -1.0, 1.0])
    y = np.array([1, 1, 1, 0, 0, 1])
    assert toxicity.deciding_logit(logit, y, 4 / 6) == 0.5
    assert toxicity.deciding_logit(np.array([0.0, 0.0]), np.array([1, 0]), 0.5) == 0.0


def test_long_null_and_empty_texts(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["good", "day", "to", "all"], 30)) + (" vile" * 3 if i % 3 == 0 else "") for i in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    model = toxicity.fit_toxicity(docs, labels, ~learned_fold(F.col("doc_id"), 3, 1))
    odd = [(1, None), (2, ""), (3, "vile " + "good day " * 60_000), (3, "x"), (None, "good day")]
    found = toxicity.score_toxicity(spark.createDataFrame(odd, docs.schema), model).collect()
    assert len(found) == 5 and all(0 <= r["score"] <= 1 for r in found)
