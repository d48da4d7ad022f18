"""Words, character n-grams and hashes of Arrow batches, shared by the text operators.

A word is a maximal run of characters other than blank and ``\\x09`` to ``\\x0D``. A batch is cut
into slices of bounded text size, so memory does not depend on the rows Spark puts in a batch;
a single text is never cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.expressions import named
from panelcast.operators.lineage import attach_facts

SLICE_BYTES = 1 << 20
MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xBF58476D1CE4E5B9)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of the batch with about ``limit`` bytes of text, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64) + 64)
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, base + limit, side="right")), start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def filled(texts: pa.Array) -> pa.Array:
    """Texts with null as the empty text."""
    return pc.fill_null(texts, "")


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row offsets (one more than rows) and the words of all rows; null texts have none."""
    trimmed = pc.ascii_trim_whitespace(filled(texts))
    lists = pc.ascii_split_whitespace(trimmed)
    empty = pc.equal(trimmed, "")
    lengths = pc.if_else(empty, 0, pc.list_value_length(lists)).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(pc.filter(lists, pc.invert(empty)))
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), flat


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row offsets, a code per word, and the distinct words the codes point to."""
    offsets, flat = split_words(texts)
    coded = flat.dictionary_encode()
    return offsets, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of every item, from row offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix of unsigned integers."""
    x = (x ^ (x >> np.uint64(30))) * MIX_B
    return (x ^ (x >> np.uint64(27))) * MIX_A


def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and code points of all words, one array."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    joined = "".join(words.to_pylist())
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), points


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of every word, the same in every process."""
    return hash_array(np.array(words.to_pylist(), dtype=object), categorize=False)


def char_grams(words: pa.Array, sizes: Sequence[int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of words framed by marks: (word index, slot) per n-gram."""
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    framed = pc.binary_join_element_wise("\x02", words, "\x03", "")
    offsets, points = code_points(framed)
    owner = row_of(offsets)
    points = points.astype(np.uint64)
    owners, slots = [], []
    for n in sizes:
        count = len(points) - n + 1
        if count <= 0:
            continue
        inside = np.flatnonzero(owner[:count] == owner[n - 1 :])
        h = np.full(len(inside), (n * int(MIX_A)) % (1 << 64), dtype=np.uint64)
        for k in range(n):
            h = mixed(h + points[inside + k])
        owners.append(owner[inside])
        slots.append((h >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(slots)


def sums_by(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` (vector or columns) by owner."""
    if values.ndim == 1:
        return np.bincount(owner, weights=values, minlength=n)
    return np.stack([np.bincount(owner, weights=c, minlength=n) for c in values.T], axis=1)


def learned_fold(key: Column, parts: int, apart: int) -> Column:
    """True for keys held out of learning: crc32 of the key as text, modulo ``parts``."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == apart, F.lit(False))


def least_hashes(rows: DataFrame, key: str, by: str, n: int | Column, seed: int) -> DataFrame:
    """The ``n`` rows of every group with the smallest hash of the key, ranked in __rank.

    Group sizes come from a count and meet the rows without moving them (``attach_facts``); a hash limit
    then leaves a few times ``n`` rows of a large group, and only those are sent and ranked. A group with
    fewer rows is whole. Rows without a group are left out.
    """
    sizes = rows.filter(named(by).isNotNull()).groupBy(by).agg(F.count("*").alias("__size"))
    hashed = F.xxhash64(named(key), F.lit(seed))
    wanted = n if isinstance(n, Column) else F.lit(n)
    share = F.least(F.lit(1.0), 2 * (wanted + 50) / F.col("__size"))
    low = F.pmod(hashed, F.lit(1 << 30)) < share * (1 << 30)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(hashed, named(key)))
    return (
        attach_facts(rows, sizes, [by], "inner")
        .filter(low)
        .withColumn("__rank", rank)
        .filter(F.col("__rank") <= wanted)
        .drop("__size")
    )


def sample_rows(
    docs: DataFrame, chosen: DataFrame, key: str, columns: Sequence[str], bound: int
) -> list:
    """One row of ``docs`` for each of at most ``bound`` keys of ``chosen`` (key, extra columns), on the driver.

    Keys and extra columns are picked first and travel as a small table, so no text of an unused
    row leaves its task. Of rows that share a key the least one is taken.
    """
    picked = chosen.limit(bound).collect()
    if not picked:
        return []
    small = docs.sparkSession.createDataFrame(picked, chosen.schema)
    extra = [c for c in chosen.columns if c != key]
    return (
        docs.select(key, *columns)
        .join(F.broadcast(small), key)
        .groupBy(key, *extra)
        .agg(F.min(F.struct(*columns)).alias("__row"))
        .select(key, *extra, "__row.*")
        .orderBy(F.xxhash64(key), key)
        .collect()
    )


def map_texts(
    df: DataFrame,
    key: str,
    text: str,
    added: Sequence[tuple[str, T.DataType]],
    work: Callable[[], Callable[[pa.Array], Sequence]],
    keep: Sequence[str] = (),
) -> DataFrame:
    """Adds columns computed from the text, slice by slice.

    ``work()`` runs once per task and returns a function from a text array to the new columns. The
    result has ``key``, the columns of ``keep`` (without clashing ones) and the new columns.
    """
    names = [n for n, _ in added]
    passed = [key, *[c for c in dict.fromkeys(keep) if c != key and c not in names]]
    column = text if text in passed else "__text"
    alone = [] if column == text else [named(text).alias("__text")]
    source = df.select(*[named(c) for c in passed], *alone)
    fields = [*[source.schema[c] for c in passed], *[T.StructField(n, t) for n, t in added]]
    kinds = [_arrow_type(t) for _, t in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = work()
        for batch in batches:
            for part in slices(batch, column):
                made = compute(part.column(column))
                arrays = [
                    a.cast(t) if isinstance(a, pa.Array) else pa.array(a, type=t)
                    for a, t in zip(made, kinds)
                ]
                columns = [part.column(c) for c in passed] + arrays
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return source.mapInArrow(run, T.StructType(fields))


def _arrow_type(kind: T.DataType) -> pa.DataType:
    return {
        T.StringType(): pa.string(),
        T.LongType(): pa.int64(),
        T.IntegerType(): pa.int32(),
        T.DoubleType(): pa.float64(),
        T.BooleanType(): pa.bool_(),
        T.BinaryType(): pa.binary(),
        T.ArrayType(T.LongType()): pa.list_(pa.int64()),
        T.ArrayType(T.StringType()): pa.list_(pa.string()),
        T.ArrayType(T.IntegerType()): pa.list_(pa.int32()),
    }[kind]
