"""Byte repeats by families of suffix arrays, against brute force over all windows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import suffix_family as sf_

FIELDS = "doc_id bigint, text string"


def brute(rows, window=50):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - window + 1):
            if d is not None:
                k = b[i : i + window]
                least[k] = min(least.get(k, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if d is not None and least[b[i : i + window]] < d:
                gone[i : i + window] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]]))).tolist()
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), len(edges) // 2, edges, kept))
    return sorted(out, key=str)


def result(frame, window=50):
    found = sf_.remove_repeated_bytes(frame, window=window).collect()
    return sorted([(r[0], r[1], r[2], r[3], list(r[4]), bytes(r[5])) for r in found], key=str)


def sample(seed, n=120):
    rng = random.Random(seed)
    words = ["ab", "c", "Ünd", "日本", "\x00", "the", "a", "\n", "zzz"]

    def text(k):
        return " ".join(rng.choice(words) for _ in range(k))

    phrase = text(9)  # crowded: ever different surroundings
    passages = [text(k) for k in (15, 25, 40, 60, 90)]
    rows = []
    for i in range(n):
        parts = [f"{rng.random()}" if rng.random() < 0.5 else text(rng.randrange(6)) for _ in range(rng.randrange(6))]
        parts += rng.sample(passages, rng.randrange(3)) + [phrase] * rng.randrange(2)
        rng.shuffle(parts)
        rows.append((rng.randrange(1000), " ".join(parts)))
    rows += [(5, "x" * 400), (3, "x" * 300 + "y"), (900, "x" * 49), (2, "y" + "x" * 120)]
    rows += [(2000 + i, passages[4]) for i in range(30)] + [(7, passages[3])] * 6 + [(7, passages[3] + passages[2])] * 2
    rows += [(1, None), (4, ""), (None, passages[4]), (None, None), (3000, passages[4] * 3), (-5, passages[0] + passages[1])]
    return rows


@pytest.mark.parametrize(
    "size, crowd", [(1 << 22, 4096), (700, 4096), (2500, 3)], ids=["one group", "many groups", "crowded anchors"]
)
def test_against_brute_force(spark, monkeypatch, size, crowd):
    monkeypatch.setattr(sf_, "BUCKET", size)
    monkeypatch.setattr(sf_, "GROUP", size)
    monkeypatch.setattr(sf_, "ANCHORS", max(size // 10, 1))
    monkeypatch.setattr(sf_, "CROWD", crowd)
    if size < 1 << 22:
        for name, value in (("FLUSH", 3000), ("BATCH", 40), ("BLOCK", 64)):
            monkeypatch.setattr(sf_, name, value)
    rows = sample(size)
    frame = spark.createDataFrame(rows, FIELDS).repartition(4)
    assert result(frame) == brute(rows)


@pytest.mark.parametrize("window", [2, 9, 31])
def test_other_windows(spark, window):
    rows = sample(window, 40)
    assert result(spark.createDataFrame(rows, FIELDS), window) == brute(rows, window)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert result(docs) == brute([tuple(r) for r in docs.collect()])


def test_empty_table_and_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "a" * 60, 5, "x"), (2, "a" * 60, 6, "y")], FIELDS + ", n_bytes int, kept string")
    assert result(frame) == brute([(1, "a" * 60), (2, "a" * 60)])
    assert result(frame.limit(0)) == []
    assert result(frame.withColumn("text", F.lit(None).cast("string"))) == brute([(1, None), (2, None)])


def test_levels_grow_geometrically():
    rng = np.random.default_rng(4)
    family, total = sf_.Family(), 0
    seen: dict[bytes, int] = {}
    for _ in range(60):
        words = np.unique(rng.integers(0, 1 << 14, 300))
        content = np.array([b"%050d" % w for w in words], "S50")
        family.add(content, rng.integers(0, 50, len(words)), total + np.arange(len(words)))
        total += len(words)
        for w in words.tolist():
            seen[w] = seen.get(w, 0) + 1
    sizes = [len(x[0]) for x in family.levels]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:])) and len(sizes) <= 1 + np.log2(total)
    for content, _, _ in family.levels:
        assert (content[1:] >= content[:-1]).all()


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(5)
    passage = rng.integers(97, 100, 200).astype(np.uint8)
    places = []
    for front in (0, 3, 70):
        data = np.concatenate([rng.integers(97, 100, front).astype(np.uint8), passage])
        found = list(sf_.anchored(np.array([0, len(data)]), data, 50))
        start, _, n, h, at = (np.concatenate(x) for x in zip(*found))
        inside = start >= front
        places.append((start[inside] - front, np.repeat(h, n)[inside], np.repeat(at, n)[inside] - front))
    for other in places[1:]:
        assert all((a == b).all() for a, b in zip(places[0], other))
