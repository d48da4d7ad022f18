"""Removal of passages that repeat across documents, by prefix-partitioned suffix trees.

Every word position with a full window behind it is a suffix. Suffixes are split into memory-sized
groups by prefixes of variable length: a census counts the suffixes under hashed prefixes of 1, 2, 4,
8 words and the whole window; a suffix belongs to its shortest prefix whose count fits. Equal
windows share every prefix, so they meet in one group. Inside a group the nodes at window
depth are the runs of equal window hashes after sorting (the tree above them is not built); a node whose smallest
document is smaller than a suffix's own marks that suffix. Marked neighbours join to maximal repeats.

What moves: packed arrays of (window hash, position) per task and group, then packed positions per
bucket of documents, then the texts once, packed per bucket. A task first settles repeats among its own documents and
sends a node's smallest document only, so a passage that a third of all documents share is one entry
per task in its group. Windows are told apart by 64-bit hashes next to the group's prefix hash.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.expressions import named
from panelcast.llm.text import coded_words, mixed, row_of, slices, split_words, word_hashes

WINDOW = 13
GROUP = 1 << 20  # suffixes of a group, and words of a bucket of documents, that suit a task's memory
SLOT_BITS = 12  # hashed prefixes the census tells apart, per length
FLUSH_WORDS = 1 << 20  # words a task gathers before it sends


def prefix_lengths(window: int) -> list[int]:
    """1, 2, 4, ... and the window itself."""
    return [*[1 << k for k in range(window.bit_length()) if 1 << k < window], window]


def prefix_hashes(g: np.ndarray, lengths: Sequence[int]) -> list[np.ndarray]:
    """Hashes of the first words of every suffix, for every length; arrays of the windows' number."""
    count = len(g) - lengths[-1] + 1
    power, made = {1: g}, []
    for n in lengths:
        if n == 1:
            made.append(g)
            continue
        h, rest, at = None, n, 0
        half = 1 << (n.bit_length() - 1)
        if half == n:  # two halves
            small = power[n // 2]
            power[n] = mixed(small[: len(small) - n // 2] * np.uint64(2 * n + 1) + small[n // 2 :])
            made.append(power[n])
            continue
        while rest:  # the binary parts of the length, large ones first
            size = 1 << (rest.bit_length() - 1)
            piece = power[size][at : at + count]
            h = piece if h is None else mixed(h * np.uint64(2 * size + 3) + piece)
            at, rest = at + size, rest - size
        made.append(h)
    return [m[:count] for m in made]


def _suffixes(texts: pa.Array, window: int):
    """(row offsets, row per suffix, position per suffix, prefix hashes by length)."""
    offsets, codes, words = coded_words(texts)
    lengths = prefix_lengths(window)
    if len(codes) < window:
        empty = np.empty(0, np.int64)
        return offsets, empty, empty, [np.empty(0, np.uint64) for _ in lengths]
    rows = row_of(offsets)
    count = len(codes) - window + 1
    inside = np.flatnonzero(rows[:count] == rows[window - 1 :])
    hashes = [h[inside] for h in prefix_hashes(word_hashes(words)[codes], lengths)]
    return offsets, rows[inside], inside - offsets[rows[inside]], hashes


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def census(docs: DataFrame, text: str, window: int) -> tuple[np.ndarray, int]:
    """Suffixes per (prefix length, slot) over all documents, and their number of words."""
    lengths = prefix_lengths(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(lengths), 1 << SLOT_BITS), np.int64)
        words = 0
        for batch in batches:
            for part in slices(batch, "__text"):
                offsets, _, _, hashes = _suffixes(part.column("__text"), window)
                words += int(offsets[-1])
                for level, h in enumerate(hashes):
                    counts[level] += np.bincount(_slot(h), minlength=1 << SLOT_BITS)
        level, slot = np.nonzero(counts)
        columns = [np.append(level, -1), np.append(slot, 0), np.append(counts[level, slot], words)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["level", "slot", "n"]
        )

    counted = docs.select(named(text).alias("__text")).mapInArrow(
        run, "level bigint, slot bigint, n bigint"
    )
    table = np.zeros((len(lengths), 1 << SLOT_BITS), np.int64)
    words = 0
    for r in counted.groupBy("level", "slot").agg(F.sum("n").alias("n")).collect():
        if r["level"] < 0:
            words = r["n"] or 0
        else:
            table[r["level"], r["slot"]] = r["n"]
    return table, words


def plan_groups(table: np.ndarray, groups: int, limit: int) -> np.ndarray:
    """The group of every (prefix length, slot); -1 where a longer prefix must decide.

    Slots that fit are dealt to the groups, large ones first, each to the least filled. The whole
    window always decides, by its hash.
    """
    chosen = np.full(table.shape, -1, np.int64)
    filled_to = np.zeros(groups, np.int64)
    for level in range(len(table) - 1):
        fits = np.flatnonzero((table[level] > 0) & (table[level] <= limit))
        if level + 1 < len(table) and len(fits):
            ordered = fits[np.argsort(-table[level][fits], kind="stable")]
            for block in np.array_split(ordered, max(1, -(-len(ordered) // groups))):
                least = np.argsort(filled_to, kind="stable")[: len(block)]
                chosen[level][block] = least
                filled_to[least] += table[level][block]
    return chosen


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight next to each other, which compress well."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned or signed integer arrays in one compressed value."""
    codec, out = pa.Codec("zstd", 1), []
    for a in arrays:
        raw = _planes(np.ascontiguousarray(a))
        small = codec.compress(raw, asbytes=True) if len(raw) else b""
        out += [struct.pack("<cIII", a.dtype.char.encode(), len(a), len(raw), len(small)), small]
    return b"".join(out)


def unpack(value: bytes) -> list[np.ndarray]:
    codec, at, out = pa.Codec("zstd", 1), 0, []
    while at < len(value):
        kind, n, raw_size, size = struct.unpack_from("<cIII", value, at)
        at += struct.calcsize("<cIII")
        dtype = np.dtype(kind.decode())
        raw = codec.decompress(value[at : at + size], raw_size, asbytes=True) if n else b""
        planes = np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(n) if n else np.empty(0, dtype))
        at += size
    return out


def _packed_places(own, rows, positions, *more) -> bytes:
    """Entries ordered by row and position: key, text mark and bucket of the rows they use, steps
    between rows and between positions, and further arrays."""
    used, code = np.unique(rows, return_inverse=True)
    row_step = np.diff(code, prepend=0)
    step = np.diff(positions, prepend=0)
    step[row_step > 0] = positions[row_step > 0]
    return pack(
        *[x[used] for x in own], row_step.astype(np.uint32), step.astype(np.uint32), *more
    )


def _places(value: bytes):
    """(Keys, text marks, buckets), row index per entry, position per entry, further arrays."""
    keys, marks, home, row_step, step, *more = unpack(value)
    rows = np.cumsum(row_step.astype(np.int64))
    total = np.cumsum(step.astype(np.int64))
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    base = np.repeat((total - step)[first], np.diff(np.append(first, len(rows))))
    return (keys, marks, home), rows, total - base, more


def _sent(docs: DataFrame, window: int, chosen: np.ndarray, groups: int) -> DataFrame:
    """(target, packed): suffixes to their groups, and positions settled in the task to buckets."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        ids = [np.concatenate([x[0][i] for x in held]) for i in range(3)]
        base = np.cumsum([0, *[len(x[0][0]) for x in held]])
        rows = np.concatenate([x[1] + b for x, b in zip(held, base)])
        positions, h, group = (np.concatenate([x[i] for x in held]) for i in (2, 3, 4))
        if not len(rows):
            return
        order = np.argsort(h)
        ordered, own = h[order], ids[0][rows[order]]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        least = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(h))))
        settled = np.zeros(len(h), bool)
        settled[order] = own > least
        target = np.where(settled, groups + ids[2][rows], group)
        order = np.argsort(target, kind="stable")  # rows and positions stay in order
        targets = target[order]
        cuts = np.append(np.flatnonzero(np.append(True, targets[1:] != targets[:-1])), len(order))
        names, values = [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = order[a:b]
            more = () if targets[a] >= groups else (h[part],)
            names.append(targets[a])
            values.append(_packed_places(ids, rows[part], positions[part], *more))
            if len(values) >= 200:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(values)], ["target", "packed"])
                names, values = [], []
        if values:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(values)], ["target", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0
        for batch in batches:
            for part in slices(batch, "__text"):
                offsets, rows, positions, hashes = _suffixes(part.column("__text"), window)
                group = np.full(len(rows), -1, np.int64)
                for level, h in enumerate(hashes[:-1]):
                    group = np.where(group < 0, chosen[level][_slot(h)], group)
                last = (hashes[-1] % np.uint64(groups)).astype(np.int64)
                group = np.where(group < 0, last, group)
                ids = [part.column(c).to_numpy(zero_copy_only=False) for c in ("__key", "__mark", "__bucket")]
                held.append((ids, rows, positions, hashes[-1], group))
                words += int(offsets[-1])
                if words >= FLUSH_WORDS:
                    yield from flush(held)
                    held, words = [], 0
        if held:
            yield from flush(held)

    return docs.mapInArrow(run, "target bigint, packed binary")


def _judged(sent: DataFrame, groups: int) -> DataFrame:
    """(bucket, packed positions to remove) from the groups of suffixes."""

    def run(table: pa.Table) -> pa.Table:
        target = table.column("target")[0].as_py()
        values = table.column("packed").to_pylist()
        if target >= groups:
            return pa.table({"bucket": pa.array([target - groups] * len(values), pa.int64()), "packed": values})
        parts = [_places(value) for value in values]
        ids = [np.concatenate([x[0][i] for x in parts]) for i in range(3)]
        base = np.cumsum([0, *[len(x[0][0]) for x in parts]])
        rows = np.concatenate([x[1] + b for x, b in zip(parts, base)])
        positions = np.concatenate([x[2] for x in parts])
        h = np.concatenate([x[3][0] for x in parts])
        order = np.argsort(h)
        ordered, own = h[order], ids[0][rows[order]]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        least = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(h))))
        marked = np.sort(order[own > least])  # a node of several documents: all but its smallest
        names, packed = [], []
        to = ids[2][rows[marked]]
        order = np.argsort(to, kind="stable")
        marked, to = marked[order], to[order]
        cuts = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to)) if len(to) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = marked[a:b]
            names.append(to[a])
            packed.append(_packed_places(ids, rows[part], positions[part]))
        return pa.table({"bucket": pa.array(names, pa.int64()), "packed": pa.array(packed, pa.binary())})

    return sent.groupBy("target").applyInArrow(run, "bucket bigint, packed binary")


def _covered(offsets: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """True per word that a removed window covers; starts are places in the flat words."""
    change = np.zeros(offsets[-1] + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return np.cumsum(change[:-1]) > 0


def _spans(covered: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Start and end word of every removed stretch, flat, per row."""
    rows = row_of(offsets)
    edge = np.append(True, (covered[1:] != covered[:-1]) | (rows[1:] != rows[:-1])) if len(covered) else covered
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(covered))[: len(first)]
    keep = covered[first] if len(first) else np.empty(0, bool)
    first, last = first[keep], last[keep]
    own = rows[first] if len(first) else np.empty(0, np.int64)
    flat = np.stack([first - offsets[own], last - offsets[own]], axis=1).ravel()
    ends = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(offsets) - 1) * 2)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def remove_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """Removes words covered by a window that also starts in a document with a smaller key.

    Returns ``key``, n_words, n_removed, spans (start and end word of every removed stretch, flat) and
    kept_text (kept words joined by a blank). Windows are judged on the input. Keys are integers. A null
    text has no words; a row with a null key takes no part and loses nothing. Rows with the same key
    are the same document: they do not remove from each other, and each loses what smaller
    documents hold. Texts are whole, however long; other columns are ignored. An empty table gives an empty one.
    """
    source = docs.select(
        named(key).cast("bigint").alias("__key"),
        named(text).alias("__text"),
        F.xxhash64(named(text)).alias("__mark"),
    )
    table, words = census(source.filter("__key is not null"), "__text", window)
    groups = max(1, -(-int(table[-1].sum()) // GROUP))
    buckets = max(1, -(-words // GROUP))
    chosen = plan_groups(table, groups, GROUP)
    # rows without a key are spread by their text, they find nothing to remove
    spread = F.when(F.col("__key").isNull(), F.col("__mark")).otherwise(F.xxhash64("__key"))
    source = source.withColumn("__bucket", F.pmod(spread, F.lit(buckets)))
    judged = _judged(_sent(source.filter("__key is not null"), window, chosen, groups), groups)

    def run(table: pa.Table) -> pa.Table:
        marked: dict[tuple[int, int], list[np.ndarray]] = {}
        texts = []
        for is_text, value in zip(table.column("texts").to_pylist(), table.column("packed").to_pylist()):
            if is_text:
                texts.append(value)
                continue
            (keys, marks, _), rows, positions, _ = _places(value)
            ends = np.append(np.flatnonzero(np.diff(rows, prepend=-1)), len(rows))
            for k, m, a, b in zip(keys.tolist(), marks.tolist(), ends[:-1], ends[1:]):
                marked.setdefault((k, m), []).append(positions[a:b])
        tables = []
        for part in (s for t in texts for b in pa.ipc.open_stream(t) for s in slices(b, "__text")):
            offsets, flat = split_words(part.column("__text"))
            ids = zip(part.column("__key").to_pylist(), part.column("__mark").to_pylist())
            starts = [offsets[i] + p for i, id_ in enumerate(ids) for p in marked.get(id_, ())]
            starts = np.concatenate(starts) if starts else np.empty(0, np.int64)
            covered = _covered(offsets, starts, window)
            sums = np.concatenate([[0], np.cumsum(~covered)])
            kept = pc.filter(flat, pa.array(~covered))
            lists = pa.ListArray.from_arrays(pa.array(sums[offsets], pa.int32()), kept)
            n_words = np.diff(offsets)
            made = (
                part.column("__key"),
                pa.array(n_words),
                pa.array(n_words - np.diff(sums[offsets])),
                _spans(covered, offsets),
                pc.binary_join(lists, " "),
            )
            tables.append(pa.table(list(made), schema=schema))
        return pa.concat_tables(tables) if tables else schema.empty_table()

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string())
    schema = pa.schema(list(zip((key, "n_words", "n_removed", "spans", "kept_text"), kinds)))
    texts = source.mapInArrow(_packed_texts, "bucket bigint, packed binary")
    every = texts.withColumn("texts", F.lit(True)).union(judged.withColumn("texts", F.lit(False)))
    return every.groupBy("bucket").applyInArrow(
        run, f"`{key}` bigint, n_words bigint, n_removed bigint, spans array<bigint>, kept_text string"
    )


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, rows of the bucket in one compressed value), slice by slice."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        for part in slices(batch, "__text"):
            home = part.column("__bucket").to_numpy(zero_copy_only=False)
            order = np.argsort(home, kind="stable")
            first = np.flatnonzero(np.append(True, home[order][1:] != home[order][:-1]))
            values = []
            for rows in np.split(order, first[1:]):
                own = part.select(["__key", "__text", "__mark"]).take(pa.array(rows))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema, options=options) as writer:
                    writer.write_batch(own)
                values.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(home[order][first]), pa.array(values, pa.binary())], ["bucket", "packed"]
            )
