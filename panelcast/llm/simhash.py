"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has 64 bits; a bit is 1 if it is set in over half the hashes of the word shingles. Two
fingerprints that differ in at most d bits share at least 8 - d of their 8 positional bytes. The index
lists different fingerprints under (positions, bytes) for every choice of that many positions, so
each pair that reaches the count meets, and no list grows beyond the values of the d bytes left
open. Inside a list the neighbours of a fingerprint are looked up bit pattern by bit pattern, not
pair by pair, so a dense list costs in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.graph import connected_components, roots
from panelcast.llm.text import filled, map_texts, split_words
from panelcast.operators.lineage import stored

SEED = 42
SHINGLE = 3
MAX_BITS = 2


def shingle_hashes(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles per row, and the hashes of all shingles in row order."""
    offsets, words = split_words(pc.ascii_lower(filled(texts)))
    counts = np.diff(offsets)
    if not len(words):
        return np.zeros(len(counts), np.int64), np.empty(0, np.uint64)
    # one buffer of all words, each followed by a blank; a shingle is a stretch of it
    data = " ".join(words.to_pylist()).encode()
    ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    first = np.repeat(offsets[:-1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    last = first + np.repeat(np.minimum(counts, shingle) - 1, sizes)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(data[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist())),
        dtype=np.uint64,
        count=len(first),
    )
    return sizes, hashes


def majority_bits(sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One fingerprint per row: the bits set in over half of the row's hashes."""
    result = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return result
    cuts = (np.cumsum(sizes) - sizes)[full]
    for bit in range(64):
        set_bits = np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), cuts)
        result[full] |= (2 * set_bits > sizes[full]).astype(np.uint64) << np.uint64(bit)
    return result


def fingerprints_of(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints of a slice of texts."""
    return majority_bits(*shingle_hashes(texts, shingle))


def fingerprints(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    keep: Sequence[str] = (),
    shingle: int = SHINGLE,
) -> DataFrame:
    """``key``, ``keep`` and fingerprint (bigint, the 64 bits) of every whole text.

    Texts are lower-cased in A-Z. A text with fewer words than a shingle has one shingle of all its
    words; a null text or one without words has fingerprint zero.
    """

    def work():
        return lambda texts: (pa.array(fingerprints_of(texts, shingle).view(np.int64)),)

    return map_texts(docs, key, text, [("fingerprint", T.LongType())], work, keep)


def _masks(max_bits: int) -> list[int]:
    """Masks of the positional bytes a list fixes: all choices of 8 - max_bits positions."""
    return [
        sum(0xFF << (8 * p) for p in range(8) if p not in left)
        for left in combinations(range(8), max_bits)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _list_links(values: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links at ``max_bits`` or fewer bits among different values of a list."""
    values = np.unique(values)
    found_a, found_b = [], []
    differing = int(np.bitwise_or.reduce(values ^ values[0]))
    bits = [np.uint64(1 << b) for b in range(64) if differing >> b & 1]
    for k in range(1, max_bits + 1):
        for chosen in combinations(bits, k):
            flipped = values ^ np.bitwise_or.reduce(np.array(chosen))
            at = np.minimum(np.searchsorted(values, flipped), len(values) - 1)
            hit = np.flatnonzero((values[at] == flipped) & (at > np.arange(len(values))))
            found_a.append(hit)
            found_b.append(at[hit])
    a = np.concatenate(found_a) if found_a else np.empty(0, np.int64)
    b = np.concatenate(found_b) if found_b else np.empty(0, np.int64)
    root = roots(len(values), a, b)
    tied = np.flatnonzero(root != np.arange(len(values)))
    return values[tied], values[root[tied]]


def near_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between different fingerprints that connect whatever lies within ``max_bits``.

    ``prints`` has a column fingerprint. Links are verified; pairs that others connect are left out.
    """
    different = prints.select("fingerprint").filter("fingerprint is not null").distinct()
    keys = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("k"))
            for i, m in enumerate(_masks(max_bits))
        ]
    )
    listed = different.select("fingerprint", F.explode(keys).alias("list"))
    # at most 256 ** max_bits different fingerprints share a list
    lists = (
        listed.groupBy("list")
        .agg(F.collect_list("fingerprint").alias("members"))
        .filter(F.size("members") > 1)
        .select("members")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            ends = column.offsets.to_numpy()
            values = column.values.to_numpy().view(np.uint64)
            a, b = [], []
            for i in range(len(batch)):
                x, y = _list_links(values[ends[i] : ends[i + 1]], max_bits)
                a.append(x)
                b.append(y)
            links = [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)] if a else [
                pa.array([], pa.int64())
            ] * 2
            yield pa.RecordBatch.from_arrays(links, names=["a", "b"])

    return lists.mapInArrow(run, "a bigint, b bigint").distinct()


def hexadecimal(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``key``, ``keep``, fingerprint (16 hex digits), component_id (smallest key reachable) and class_id.

    Texts link at ``max_bits`` or fewer differing bits. Null and empty texts have fingerprint zero and
    link like any other; whole texts count, however long. A row without a key links too, but names no
    class: component_id is null where no row of the class has a key. Rows that share a key may be in
    different classes, which then can have the same component_id; class_id, a number of the class
    itself, tells them apart. Repeated rows give repeated results; an empty table gives an empty one.
    Columns of ``keep`` named like a new column are dropped. Groups of equal fingerprints become one
    node before any comparison.
    """
    added = ("fingerprint", "component_id", "class_id")
    keep = [c for c in keep if c not in added]
    prints = stored(fingerprints(docs, key, text, keep, shingle))
    nodes = stored(prints.groupBy("fingerprint").agg(F.min(key).alias("__least")))
    components = connected_components(near_links(nodes, max_bits))
    # a class is named by its smallest key: one row per different fingerprint
    classed = nodes.join(components, nodes["fingerprint"] == components["node"], "left").select(
        "fingerprint", "__least", F.coalesce("component", "fingerprint").alias("__class")
    )
    least = classed.groupBy("__class").agg(F.min("__least").alias("component_id"))
    named_nodes = classed.join(least, "__class").select(
        "fingerprint", "component_id", F.col("__class").alias("class_id")
    )
    return prints.join(named_nodes, "fingerprint").select(
        key, *keep, hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id", "class_id"
    )
