"""Embedding near-duplicates by E8 lattice hashing.

Vectors are scaled to unit length. A table projects them by random directions to blocks of eight
numbers and decodes each block to the nearest point of the lattice E8; the points of its blocks are
the home cell. A vector also probes neighbouring cells: a block's second nearest point replaces the
nearest, one block at a time, the likeliest first. Two vectors of a label meet in a table if they
share the home cell or one probes the other's home; their cosine is then computed in double
precision. A pair that meets in several places counts in the first one only.

A crowded cell is cut into blocks of bounded size by hash, and blocks are compared two at a time in
separate groups, so no task holds a cell. Pairs are not written out: a group returns links per
vector and a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.expressions import named
from panelcast.llm.graph import connected_components, roots
from panelcast.llm.text import mixed
from panelcast.operators.lineage import stored

COSINE = 0.93
TABLES = 16
BLOCKS = 2  # blocks of eight projections per table
PROBES = 2
REACH = 0.2  # lattice units between vectors at the threshold, per projected number
CELL_ROWS = 512  # rows of a cell that are compared in one group


def e8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest and another near point of E8 for rows of eight numbers, in half units, and the gap.

    E8 is D8 (integer points of even sum) and D8 moved by a half in every coordinate; each has its own
    nearest point, the nearer one is the answer and the other the neighbour. The gap is the difference
    of their squared distances.
    """

    def d8(y: np.ndarray) -> np.ndarray:
        z = np.rint(y)
        odd = np.flatnonzero(z.sum(axis=1) % 2 != 0)
        off = y[odd] - z[odd]
        worst = np.abs(off).argmax(axis=1)
        step = np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
        z[odd, worst] += step
        return z

    whole, half = d8(x), d8(x - 0.5) + 0.5
    far = ((x - half) ** 2).sum(axis=1) - ((x - whole) ** 2).sum(axis=1)
    near = far >= 0
    first = np.where(near[:, None], whole, half)
    second = np.where(near[:, None], half, whole)
    return (2 * first).astype(np.int64), (2 * second).astype(np.int64), np.abs(far)


def _cell(points: np.ndarray) -> np.ndarray:
    """One 64-bit number per row of lattice points."""
    h = np.zeros(len(points), np.uint64)
    for column in points.T:
        h = mixed(h * np.uint64(3) + column.view(np.uint64))
    return h


def cells(
    unit: np.ndarray,
    cosine: float = COSINE,
    tables: int = TABLES,
    blocks: int = BLOCKS,
    seed: int = 7,
) -> tuple[np.ndarray, np.ndarray]:
    """Home cell (rows x tables) and probed cells (rows x tables x PROBES) of unit vectors.

    Projections are scaled so that vectors at the threshold lie ``REACH`` apart per number.
    """
    scale = REACH / np.sqrt(max(2 - 2 * cosine, 1e-6))
    n, dim = unit.shape
    home = np.zeros((n, tables), np.uint64)
    probes = np.zeros((n, tables, min(PROBES, blocks)), np.uint64)
    for t in range(tables):
        rng = np.random.default_rng([seed, t, dim])
        x = unit @ rng.normal(size=(dim, 8 * blocks)) * scale
        decoded = [e8(x[:, 8 * b : 8 * b + 8]) for b in range(blocks)]
        first = np.hstack([d[0] for d in decoded])
        home[:, t] = _cell(first)
        order = np.argsort(np.stack([d[2] for d in decoded], axis=1), axis=1, kind="stable")
        moved = []
        for b in range(blocks):
            other = first.copy()
            other[:, 8 * b : 8 * b + 8] = decoded[b][1]
            moved.append(_cell(other))
        moved = np.stack(moved, axis=1)
        probes[:, t] = np.take_along_axis(moved, order, axis=1)[:, : probes.shape[2]]
    return home, probes


def _units(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows with a usable vector, and their unit vectors grouped by length in row order."""
    lists = column.to_pylist()
    rows, vectors = [], []
    for i, v in enumerate(lists):
        if v is None or not len(v) or any(x is None for x in v):
            continue
        x = np.asarray(v, np.float64)
        if not np.isfinite(x).all():
            continue
        top = np.abs(x).max()
        if top == 0:
            continue
        x = x / top
        rows.append(i)
        vectors.append(x / np.sqrt(x @ x))
    return np.array(rows, np.int64), vectors


def _entries(vectors: DataFrame, cosine: float) -> DataFrame:
    """One row per vector, table and visited cell, with the unit vector and all cells of the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                rows, units = _units(part.column("__v"))
                keys = part.column("__key").to_numpy(zero_copy_only=False)
                marks = part.column("__label").to_numpy(zero_copy_only=False)
                lengths = np.array([len(u) for u in units], np.int64)
                for dim in np.unique(lengths):
                    own = np.flatnonzero(lengths == dim)
                    unit = np.stack([units[i] for i in own])
                    home, probes = cells(unit, cosine)
                    n, tables = home.shape
                    all_cells = np.concatenate([home, probes.reshape(n, -1)], axis=1)
                    packed = [
                        u.tobytes() + c.tobytes() for u, c in zip(unit, all_cells)
                    ]
                    visited = np.concatenate([home[:, :, None], probes], axis=2)
                    shape = visited.shape
                    who = np.broadcast_to(np.arange(n)[:, None, None], shape).ravel()
                    table = np.broadcast_to(np.arange(tables)[None, :, None], shape).ravel()
                    probing = np.broadcast_to(np.arange(shape[2])[None, None, :] > 0, shape).ravel()
                    cell = mixed(visited.ravel() + (table * 1000 + int(dim)).astype(np.uint64))
                    for a in range(0, len(who), 4000):
                        w = who[a : a + 4000]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(marks[rows[own[w]]]),
                                pa.array(cell[a : a + 4000].view(np.int64)),
                                pa.array(table[a : a + 4000].astype(np.int32)),
                                pa.array(probing[a : a + 4000]),
                                pa.array(keys[rows[own[w]]]),
                                pa.array([packed[i] for i in w], pa.binary()),
                                pa.array(np.full(len(w), dim, np.int32)),
                            ],
                            names=["label", "cell", "tab", "probing", "id", "packed", "dim"],
                        )

    return vectors.mapInArrow(
        run,
        "label bigint, cell bigint, tab int, probing boolean, id bigint, packed binary, dim int",
    )


def _met_before(a: np.ndarray, b: np.ndarray, table: int, tables: int) -> np.ndarray:
    """True for row pairs that share a place in a table before ``table``; columns as in ``_entries``."""
    met = np.zeros(len(a), bool)
    probes = (a.shape[1] - tables) // tables
    for t in range(table):
        ha, hb = a[:, t], b[:, t]
        met |= ha == hb
        for k in range(tables + t * probes, tables + (t + 1) * probes):
            met |= (a[:, k] == hb) | (b[:, k] == ha)
    return met


def _home_probes_other(a: np.ndarray, b: np.ndarray, table: int, tables: int) -> np.ndarray:
    """True where a row of ``a`` probes the home of its row of ``b`` in the table."""
    probes = (a.shape[1] - tables) // tables
    hit = np.zeros(len(a), bool)
    for k in range(tables + table * probes, tables + (table + 1) * probes):
        hit |= a[:, k] == b[:, table]
    return hit


def _compared(entries: DataFrame, cosine: float, tables: int) -> DataFrame:
    """(id, n_links, root): links found per vector, and a spanning forest, from all cell blocks."""

    def run(table: pa.Table) -> pa.Table:
        dim, tab = table.column("dim")[0].as_py(), table.column("tab")[0].as_py()
        ids = table.column("id").to_numpy()
        side = table.column("side").to_numpy()
        probing = table.column("probing").to_numpy(zero_copy_only=False)
        raw = np.frombuffer(b"".join(table.column("packed").to_pylist()), np.uint8).reshape(len(ids), -1)
        unit = np.ascontiguousarray(raw[:, : 8 * dim]).view(np.float64)
        own = np.ascontiguousarray(raw[:, 8 * dim :]).view(np.uint64)
        left = np.flatnonzero(side != 1)  # 0: both sides, a block with itself; 1, 2: two blocks
        right = np.flatnonzero(side != 2)
        x, y = np.nonzero(unit[left] @ unit[right].T >= cosine)
        a, b = left[x], right[y]
        if (side == 0).all():
            a, b = a[a < b], b[a < b]
        keep = (ids[a] != ids[b]) & ~(probing[a] & probing[b])
        a, b = a[keep], b[keep]
        keep = ~_met_before(own[a], own[b], tab, tables)
        # two vectors that probe each other's home meet twice: the smaller home cell counts
        both = _home_probes_other(own[a], own[b], tab, tables) & _home_probes_other(
            own[b], own[a], tab, tables
        )
        at_home = np.where(probing[a], own[b, tab], own[a, tab])
        keep &= ~both | (at_home == np.minimum(own[a, tab], own[b, tab]))
        a, b = a[keep], b[keep]
        counts = np.bincount(np.concatenate([a, b]), minlength=len(ids))
        used = np.flatnonzero(counts)
        root = roots(len(ids), a, b)
        return pa.table({"id": ids[used], "n_links": counts[used], "root": ids[root[used]]})

    return entries.groupBy("label", "cell", "pair").applyInArrow(
        run, "id bigint, n_links bigint, root bigint"
    )


def near_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    cosine: float = COSINE,
) -> DataFrame:
    """``key``, n_links, component_id and kept per row of ``vectors``.

    Only vectors of one label, not null, are compared. A vector that is null, empty or zero, or holds a
    null or non-finite number, links with nothing, nor does one of another length. Keys are integers;
    rows with the same key are one vector to the links (they do not link with each other), the least of them by
    label and numbers, and each gets the key's result. Other columns are ignored. A row with a null key has no links and no component. An empty table gives an
    empty one.
    """
    # rows of a key are one vector
    source = stored(
        vectors.filter(named(key).isNotNull() & named(label).isNotNull())
        .select(
            named(key).cast("bigint").alias("__key"),
            F.xxhash64(named(label)).alias("__label"),
            named(embedding).cast("array<double>").alias("__v"),
        )
        .groupBy("__key")
        .agg(F.min(F.struct("__label", "__v")).alias("__one"))
        .select("__key", "__one.*")
    )
    entries = _entries(source, cosine)
    # cells with one visitor hold no pair; crowded ones are cut into blocks
    sizes = entries.groupBy("label", "cell").agg(
        F.count("*").alias("n"), F.sum(F.col("probing").cast("int")).alias("p")
    )
    met = sizes.filter("n > 1 and p < n").select(
        "label", "cell", F.ceil(F.col("n") / F.lit(CELL_ROWS)).cast("int").alias("blocks")
    )
    entries = entries.join(met, ["label", "cell"])
    block = F.pmod(F.xxhash64("id", F.lit(17)), F.col("blocks")).cast("int")
    entries = entries.withColumn("block", block)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    entries = entries.withColumn("other", other).select(
        "*",
        (low.cast("bigint") * F.col("blocks") + high).alias("pair"),
        F.when(F.col("block") == F.col("other"), 0)
        .when(F.col("block") < F.col("other"), 1)
        .otherwise(2)
        .alias("side"),
    )
    found = stored(_compared(entries, cosine, TABLES))
    links = found.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    forest = found.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    components = connected_components(forest)
    result = (
        vectors.select(named(key))
        .join(links.withColumnRenamed("id", key), key, "left")
        .join(components.withColumnRenamed("node", key), key, "left")
    )
    component = F.coalesce("component", named(key).cast("bigint"))
    return result.select(
        named(key),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(named(key) == component, F.lit(True)).alias("kept"),
    )
