"""Components, SimHash and lattice hashing against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from panelcast.llm import graph, lattice, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_random_links(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(40)]
    links += [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(120)]
    links += [(5, 5), (3, 2), (3, 2)]
    frame = spark.createDataFrame([*links, (None, 7)], "a bigint, b bigint")
    found = {r["node"]: r["component"] for r in graph.connected_components(frame).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert found == brute_components(nodes, [(a, b) for a, b in links if a != b])
    assert graph.connected_components(frame.filter(F.lit(False))).count() == 0


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(
        1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes)
    )


def brute_simhash(rows):
    prints = [(d, brute_fingerprint(t)) for d, t in rows]
    different = sorted({p for _, p in prints})
    links = [
        (a, b) for i, a in enumerate(different) for b in different[i + 1 :] if (a ^ b).bit_count() <= 2
    ]
    group = brute_components(different, links)
    least = {}
    for d, p in prints:
        if d is not None:
            least[group[p]] = min(least.get(group[p], d), d)
    return sorted([(d, f"{p:016x}", least.get(group[p])) for d, p in prints], key=str)


def test_simhash_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "One TWO"), (9003, "one two"), (None, "x y z w")]
    base = rows[0][1].split()
    for i in range(30):  # chains of small changes
        base = [*base[:5], f"w{i}", *base[6:]]
        rows.append((9100 + i, " ".join(base)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    result = simhash.near_duplicates(frame)
    found = sorted([tuple(r)[:3] for r in result.collect()], key=str)
    assert found == brute_simhash(rows)
    # a class has one smallest key
    assert result.groupBy("class_id").agg(F.countDistinct("component_id").alias("n")).filter("n > 1").count() == 0
    assert simhash.near_duplicates(frame.filter(F.lit(False))).count() == 0


def test_dense_list_is_linked_without_pairs():
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 1 << 12, 900, dtype=np.uint64))
    a, b = simhash._list_links(values, 2)
    assert len(a) < len(values)
    every = [
        (int(x), int(y))
        for i, x in enumerate(values)
        for y in values[i + 1 :]
        if (int(x) ^ int(y)).bit_count() <= 2
    ]
    nodes = [int(v) for v in values]
    assert brute_components(nodes, zip(a.tolist(), b.tolist())) == brute_components(nodes, every)


def test_e8_points_are_the_nearest():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1.5, (200, 8))
    first, second, gap = lattice.e8(x)
    half = first % 2
    assert ((half == half[:, :1]).all(axis=1) & ((first.sum(axis=1) % 4) == 0)).all()
    distance = ((x - first / 2) ** 2).sum(axis=1)
    roots = [v for v in np.ndindex(*(3,) * 8) if sum(abs(k - 1) for k in v) == 2]
    for r in roots:  # no neighbour by a short vector is nearer
        assert (((x - first / 2 - (np.array(r) - 1)) ** 2).sum(axis=1) >= distance - 1e-9).all()
    assert np.allclose(((x - second / 2) ** 2).sum(axis=1) - distance, gap)


def make_vectors(spark, n=400, crowd=1500):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        v = rng.normal(size=32)
        rows.append((i, v.tolist(), i % 3))
        if i % 4 == 0:
            rows.append((10_000 + i, (3 * v + rng.normal(size=32) * 0.6).tolist(), i % 3))
        if i % 20 == 0:
            rows.append((20_000 + i, v.tolist(), (i + 1) % 3))
    centre = rng.normal(size=32)
    rows += [(30_000 + i, (centre + rng.normal(size=32) * 0.2).tolist(), 7) for i in range(crowd)]
    nan = float("nan")
    rows += [(-1, None, 1), (-2, [0.0] * 32, 1), (-3, [1.0, None], 1), (-4, [nan] * 32, 1)]
    rows += [(-5, [], 1), (-6, rows[0][1], None), (-7, [1.0, 2.0], 0), (None, rows[0][1], 0)]
    rows.append(rows[0])
    return rows, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")


def test_lattice_against_brute_force(spark):
    rows, frame = make_vectors(spark)
    usable = {}
    for key, v, label in rows:
        if key is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        if any(v):
            usable[key] = (np.array(v) / np.linalg.norm(v), label)
    keys = sorted(usable)
    links, count = [], dict.fromkeys(keys, 0)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            (x, p), (y, q) = usable[a], usable[b]
            if p == q and len(x) == len(y) and x @ y >= lattice.COSINE:
                links.append((a, b))
                count[a] += 1
                count[b] += 1
    found = lattice.near_vectors(frame).collect()
    assert len(found) == len(rows)
    assert all(r["n_links"] <= count.get(r["vec_id"], 0) for r in found if r["vec_id"] is not None)
    total = sum({r["vec_id"]: r["n_links"] for r in found}.values())
    assert total >= 0.95 * 2 * len(links)
    component = brute_components(keys, links)
    same = [r["component_id"] == component.get(r["vec_id"], r["vec_id"]) for r in found]
    assert np.mean(same) > 0.99
    assert all(r["kept"] == (r["component_id"] in (None, r["vec_id"])) for r in found)
    odd = {r["vec_id"]: r for r in found}
    for key in (-1, -2, -3, -4, -5, -6, -7):
        assert (odd[key]["n_links"], odd[key]["component_id"], odd[key]["kept"]) == (0, key, True)
    assert lattice.near_vectors(frame.filter(F.lit(False))).count() == 0


def planted_vectors(rng, n, dim, low, high):
    """Pairs of unit vectors in general position at cosines between ``low`` and ``high``."""
    a, b = rng.normal(size=(2, n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = rng.uniform(low, high, (n, 1))
    return a, c * a + np.sqrt(1 - c * c) * b


def test_lattice_recall_by_cosine_band(spark):
    rng = np.random.default_rng(6)
    rows, key = [], 0
    bands = [(0.9301, 0.94), (0.94, 0.95), (0.95, 0.97)]
    for label, (low, high) in enumerate(bands):
        for a, b in zip(*planted_vectors(rng, 400, 64, low, high)):
            rows += [(key, a.tolist(), label), (key + 1, b.tolist(), label)]
            key += 2
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    found = {r["vec_id"]: r["n_links"] for r in lattice.near_vectors(frame).collect()}
    recall = [np.mean([found[v] for v, _, own in rows if own == label]) for label in range(len(bands))]
    assert min(recall) >= 0.95 and max(recall) <= 1


def test_cells_meet_at_the_threshold_for_any_length():
    for dim in (32, 64, 256):
        a, b = planted_vectors(np.random.default_rng(dim), 1500, dim, 0.93, 0.94)
        (ha, pa), (hb, pb) = lattice.cells(a), lattice.cells(b)
        met = (ha == hb) | (pa == hb[:, :, None]).any(axis=2) | (pb == ha[:, :, None]).any(axis=2)
        assert met.any(axis=1).mean() >= 0.97
