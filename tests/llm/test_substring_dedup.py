"""Removal of repeated passages against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=13):
    least, words = {}, [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in words:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                least[k] = min(least.get(k, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        if d is not None:
            for i in range(len(w) - window + 1):
                if least[tuple(w[i : i + window])] < d:
                    gone[i : i + window] = [True] * window
        spans, start = [], None
        for i, g in enumerate([*gone, False]):
            if g and start is None:
                start = i
            elif not g and start is not None:
                spans += [start, i]
                start = None
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), spans, kept))
    return sorted(out, key=str)


def passages(seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdef") for _ in range(40)) for _ in range(6)]
    rows = []
    for i in range(250):
        parts = [
            rng.choice(base)
            if rng.random() < 0.5
            else "\n".join(rng.choice(["x", "y", "zé", "a"]) for _ in range(rng.randint(0, 30)))
            for _ in range(rng.randint(0, 4))
        ]
        text = "  ".join(parts)
        rows.append((rng.randint(-50, 220) if i % 40 else None, text if i % 17 else None))
    return rows + rows[:9]


@pytest.mark.parametrize("group", [1 << 20, 60])
def test_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    rows = passages(5)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    docs = docs.withColumn("n_words", F.lit("clash"))
    assert sorted([tuple(r) for r in substring_dedup.remove_repeats(docs).collect()], key=str) == brute(rows)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = substring_dedup.remove_repeats(docs)
    rows = [tuple(r) for r in docs.collect()]
    assert sorted([tuple(r) for r in found.collect()], key=str) == brute(rows)


def test_empty_table(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_groups_fit_and_packing_returns(monkeypatch):
    rng = np.random.default_rng(1)
    table = rng.integers(0, 50, (5, 1 << substring_dedup.SLOT_BITS))
    table[0, 3] = 10_000
    chosen = substring_dedup.plan_groups(table, 7, 100)
    assert chosen[0, 3] == -1 and chosen[1, 3] >= 0 and (chosen[-1] == -1).all()
    loads = np.bincount(chosen[0][chosen[0] >= 0], weights=table[0][chosen[0] >= 0])
    assert loads.max() < 1.2 * loads.mean()
    arrays = [np.array([5, -7, 1 << 40]), np.arange(3, dtype=np.uint32), np.empty(0, np.uint64)]
    assert all((a == b).all() for a, b in zip(arrays, substring_dedup.unpack(substring_dedup.pack(*arrays))))
