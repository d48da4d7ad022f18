"""Removal of byte strings that repeat across documents, by families of suffix arrays.

Suffixes that begin with the same window meet in one group, and each group keeps a logarithmic family of
suffix arrays: suffixes that arrive are gathered to batches, a batch is sorted by content, scanned against
every level for equal windows, and levels of about equal size merge, so that sizes grow
geometrically. The suffix of the smallest document stays in the family, any other is marked.

Only suffixes that may repeat travel. Every window has an anchor, the k-gram of least hash in it, so equal
windows have equal anchors at equal places:

* A pass over the texts sends a short fingerprint of every anchor (one per 13 bytes or so); an anchor that
  two documents hold makes candidates of its windows. A chance collision only makes a candidate more.
* The texts go to buckets. A bucket sorts its candidate suffixes, marks those that also start in a
  smaller document of the bucket, and sends the others, neighbours in one stretch of bytes, to the group of their
  anchor. A passage that many documents share leaves a bucket once.
* An anchor that is crowded (a common phrase with ever different surroundings) is known from the first
  pass; its suffixes go to groups by their own content instead. At most ``CROWDED`` anchors are, by
  their least number of occurrences.
* Marks return to the buckets, where the covered bytes are left out.

Matches are compared byte by byte. What a task holds is bounded by ``BUCKET`` and ``GROUP``, but for a
single long text, which is held by its task in a few copies.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.expressions import named
from panelcast.llm.substring_dedup import _spans
from panelcast.llm.text import filled, mixed, row_of, slices
from panelcast.operators.lineage import stored

WINDOW = 50
BUCKET = 1 << 22  # bytes of text in a bucket
GROUP = 1 << 22  # bytes of text whose suffixes a group may hold, if all repeat
ANCHORS = 1 << 20  # anchors of a group of the first pass
CROWDED = 1 << 20  # most anchors whose suffixes are dealt by content
CROWD = 4096  # fewest occurrences of such an anchor
BATCH = 1 << 18  # suffixes that make up a batch
BLOCK = 1 << 17  # windows formed at once
FLUSH = 1 << 23  # bytes of text a task gathers before it sends


def packed(*arrays: np.ndarray) -> bytes:
    """Integer arrays in one compressed value, bytes of equal weight next to each other."""
    head, raw = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(struct.pack("<cI", a.dtype.char.encode(), len(a)))
        raw.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    body = b"".join(raw)
    return b"".join(head) + pa.Codec("zstd", 1).compress(body, asbytes=True) if body else b"".join(head)


def unpacked(value: bytes) -> list[np.ndarray]:
    count, at, kinds = value[0], 1, []
    for _ in range(count):
        kind, n = struct.unpack_from("<cI", value, at)
        kinds.append((np.dtype(kind.decode()), n))
        at += struct.calcsize("<cI")
    size = sum(d.itemsize * n for d, n in kinds)
    body = pa.Codec("zstd", 1).decompress(value[at:], size, asbytes=True) if size else b""
    out, at = [], 0
    for dtype, n in kinds:
        planes = np.frombuffer(body, np.uint8, dtype.itemsize * n, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(n) if n else np.empty(0, dtype))
        at += dtype.itemsize * n
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and the UTF-8 bytes of all texts; null texts have none."""
    texts = filled(texts)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(len(texts) + 1, np.int64), np.empty(0, np.uint8)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return offsets.astype(np.int64) - offsets[0], data


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k-gram of bytes: a polynomial, put together from halves, mixed at the end."""
    base = pow(0x9E3779B97F4A7C15, 1, 1 << 64)
    size, h, out, done = 1, data.astype(np.uint64), None, 0
    while True:
        if k & size:  # the binary parts of k, small ones first
            shift = np.uint64(pow(base, done, 1 << 64))
            count = len(data) - k + 1
            part = h[k - done - size :][:count]
            out = part.copy() if out is None else out + part * shift
            done += size
        if 2 * size > k:
            return mixed(out)
        h = h[: len(h) - size] * np.uint64(pow(base, size, 1 << 64)) + h[size:]
        size *= 2


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n neighbours."""
    span = 1
    while 2 * span <= n:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = n - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def anchored(offsets: np.ndarray, data: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Windows that lie in one row, block by block, and the runs of neighbours with one anchor: (start and row of every
    window, number of windows, hash and place of the anchor of every run)."""
    k = window // 2
    rows = row_of(offsets)
    place = np.uint64((1 << 32) - 1)
    for low in range(0, len(data) - window + 1, BLOCK):
        part = data[low : low + BLOCK + window - 1]
        h = gram_hashes(part, k)
        # the first of equal hashes is the anchor: the place breaks ties
        least = sliding_least((h & ~place) | np.arange(len(h), dtype=np.uint64), window - k + 1) & place
        n = len(least)
        inside = np.flatnonzero(rows[low : low + n] == rows[low + window - 1 : low + window - 1 + n])
        at = least[inside].astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        size = np.diff(np.append(first, len(at)))
        yield low + inside, rows[low + inside], size, h[at[first]], low + at[first]


def contents(data: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """The windows' bytes, compared as they are; all have one length."""
    if not len(starts):
        return np.empty(0, f"S{window}")
    return np.lib.stride_tricks.sliding_window_view(data, window)[starts].view(f"S{window}").ravel()


def content_order(found: np.ndarray) -> np.ndarray:
    """The order of the windows by content: by their first eight bytes, and whole where those are equal."""
    window = found.dtype.itemsize
    if window < 8:
        return np.argsort(found, kind="stable")
    head = np.ascontiguousarray(found.view(np.uint8).reshape(len(found), window)[:, :8])
    head = head.view(">u8").ravel().astype(np.uint64)
    order = np.argsort(head)
    ordered = head[order]
    same = ordered[1:] == ordered[:-1]
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same)) if len(found) else order
    some = order[tied]
    order[tied] = some[np.argsort(found[some], kind="stable")]
    return order


def content_hashes(found: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every window."""
    window = found.dtype.itemsize
    wide = np.zeros((len(found), -(-window // 8) * 8), np.uint8)
    wide[:, :window] = found.view(np.uint8).reshape(len(found), window)
    h = np.zeros(len(found), np.uint64)
    for word in wide.view(np.uint64).T:
        h = mixed(h * np.uint64(3) + word + np.uint64(7))
    return h


def runs(found: np.ndarray, order: np.ndarray) -> np.ndarray:
    """True where a sorted window differs from the one before."""
    new = np.ones(len(order), bool)
    for low in range(1, len(order), BLOCK):
        part = found[order[low - 1 : low + BLOCK]]
        new[low : low + BLOCK] = part[1:] != part[:-1]
    return new


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """True where x is one of the sorted values."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def codes_of(h: np.ndarray, groups: int) -> np.ndarray:
    """Group and 32 bits of an anchor's hash; a group has few enough anchors for 32 bits to tell them apart."""
    return (h % np.uint64(groups)) << np.uint64(32) | h >> np.uint64(32)


def _by(target: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every different target with the places it has, in order."""
    order = np.argsort(target, kind="stable")
    first = np.flatnonzero(np.diff(target[order], prepend=-1))
    return zip(target[order][first].tolist(), np.split(order, first[1:]) if len(first) else [])


def _rows(pairs: Sequence[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(pairs), 500):
        some = pairs[low : low + 500]
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in some], pa.int64()), pa.array([v for _, v in some], pa.binary())],
            names=["target", "packed"],
        )


def _table(pairs: Sequence[tuple[int, bytes]]) -> pa.Table:
    batches = list(_rows(pairs))
    schema = pa.schema([("target", pa.int64()), ("packed", pa.binary())])
    return pa.Table.from_batches(batches) if batches else schema.empty_table()


def sent_anchors(docs: DataFrame, window: int, groups: int, buckets: int) -> DataFrame:
    """(target, packed): anchors to their groups; to buckets those that two documents of the task hold."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        code, key, bucket = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((bucket, code))
        code, key, bucket = code[order], key[order], bucket[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.empty(0, np.int64)
        if not len(first):
            return
        n = np.diff(np.append(first, len(code)))
        shared = np.minimum.reduceat(key, first) != np.maximum.reduceat(key, first)
        pairs = []
        group = (code[first] >> np.uint64(32)).astype(np.int64)
        mark = code[first].astype(np.uint32)
        home = np.where(shared, buckets, bucket[first])  # nobody waits for an answer about a shared one
        for g, at in _by(group):
            pairs.append((g, packed(mark[at], home[at].astype(np.uint32), n[at].astype(np.uint32))))
        told = np.flatnonzero(np.repeat(shared, n))
        for b, at in _by(bucket[told]):
            pairs.append((groups + b, packed(np.unique(code[told[at]]))))
        yield from _rows(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "__text"):
                key, bucket = (part.column(c).to_numpy(zero_copy_only=False) for c in ("__key", "__bucket"))
                offsets, data = text_bytes(part.column("__text"))
                for _, row, n, h, _ in anchored(offsets, data, window):
                    own = row[np.cumsum(n) - n]
                    held.append((codes_of(h, groups), key[own], bucket[own]))
                size += len(data)
                if held and size >= FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return docs.mapInArrow(run, "target bigint, packed binary")


def repeated_anchors(sent: DataFrame, groups: int, buckets: int, crowd: float) -> DataFrame:
    """(target, packed): per bucket the anchors that two documents may hold; crowded ones at target -1."""

    def run(table: pa.Table) -> pa.Table:
        target, values = table.column("target")[0].as_py(), table.column("packed").to_pylist()
        if target >= groups:
            return _table([(target - groups, v) for v in values])
        parts = [unpacked(v) for v in values]
        mark, home, n = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(mark, kind="stable")
        mark, home, n = mark[order], home[order], n[order]
        first = np.flatnonzero(np.append(True, mark[1:] != mark[:-1]))
        size = np.diff(np.append(first, len(mark)))
        again = (size > 1) | (np.maximum.reduceat(home, first) == buckets)
        told = np.flatnonzero(np.repeat(again, size) & (home < buckets))
        base = np.uint64(target) << np.uint64(32)
        pairs = [(b, packed(base | np.unique(mark[told[at]]).astype(np.uint64))) for b, at in _by(home[told].astype(np.int64))]
        many = first[np.add.reduceat(n.astype(np.int64), first) >= crowd]
        if len(many):
            pairs.append((-1, packed(base | mark[many].astype(np.uint64))))
        return _table(pairs)

    return sent.groupBy("target").applyInArrow(run, "target bigint, packed binary")


def packed_texts(docs: DataFrame) -> DataFrame:
    """(bucket, packed): the rows of a bucket that a task holds; repeated rows once, with their number."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        table = pa.Table.from_batches(held).combine_chunks()
        marks = table.column("__mark").to_numpy()
        _, first, n = np.unique(marks, return_index=True, return_counts=True)
        table = table.take(pa.array(first)).append_column("__n", pa.array(n, pa.int64()))
        home = table.column("__bucket").to_numpy()
        names, values = [], []
        for b, at in _by(home):
            own = table.select(["__key", "__text", "__mark", "__n"]).take(pa.array(at)).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema, options=options) as writer:
                writer.write_table(own)
            names.append(b)
            values.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(values, pa.binary())], ["bucket", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "__text"):
                held.append(part)
                size += part.nbytes
                if size >= FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return docs.mapInArrow(run, "bucket bigint, packed binary")


def bucket_rows(table: pa.Table) -> pa.Table:
    """The different rows of a bucket (__key, __text, __mark, __n)."""
    parts = [pa.ipc.open_stream(v).read_all() for v in table.column("packed").to_pylist()]
    rows = pa.concat_tables(parts).combine_chunks()
    _, first, same = np.unique(rows.column("__mark").to_numpy(), return_index=True, return_inverse=True)
    n = np.bincount(same, weights=rows.column("__n").to_numpy(), minlength=len(first)).astype(np.int64)
    rows = rows.take(pa.array(first))
    return rows.set_column(rows.column_names.index("__n"), "__n", pa.array(n)).combine_chunks()


def _places(keys: np.ndarray, marks: np.ndarray, rows: np.ndarray, positions: np.ndarray, *more: np.ndarray) -> bytes:
    """Places (row, position) in order: key and mark of the rows used, steps between places, more arrays."""
    row_step = np.diff(rows, prepend=-1) != 0
    used = rows[row_step]
    step = np.diff(positions, prepend=0)
    step[row_step] = positions[row_step]
    row_step[:1] = False
    return packed(keys[used], marks[used], row_step.view(np.uint8), step.astype(np.uint32), *more)


def _unplaced(value: bytes) -> tuple[np.ndarray, ...]:
    """Keys, marks, row per place, position per place, more arrays."""
    keys, marks, row_step, step, *more = unpacked(value)
    rows, total = np.cumsum(row_step.astype(np.int64)), np.cumsum(step.astype(np.int64))
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    base = np.repeat((total - step)[first], np.diff(np.append(first, len(rows))))
    return keys, marks, rows, total - base, *more


def bucket_suffixes(window: int, anchor_groups: int, groups: int, crowded: np.ndarray):
    """A bucket's candidate suffixes: marks settled in it, and stretches for the groups."""

    def run(texts: pa.Table, flags: pa.Table) -> pa.Table:
        if not texts.num_rows or not flags.num_rows:
            return _table([])
        bucket = texts.column("bucket")[0].as_py()
        known = np.unique(np.concatenate([unpacked(v)[0] for v in flags.column("packed").to_pylist()]))
        rows = bucket_rows(texts)
        rows = rows.filter(rows.column("__key").is_valid())
        if not rows.num_rows:
            return _table([])
        keys, marks = (rows.column(c).to_numpy() for c in ("__key", "__mark"))
        offsets, data = text_bytes(rows.column("__text"))
        # per candidate window its start, its row and its anchor; per anchor its code and place
        found, codes, places, anchors = [], [], [], 0
        for start, row, n, h, at in anchored(offsets, data, window):
            code = codes_of(h, anchor_groups)
            hit = among(code, known)
            every, n = np.repeat(hit, n), n[hit]
            anchor = np.repeat(np.arange(anchors, anchors + len(n)), n)
            found.append([x.astype(np.int32) for x in (start[every], row[every], anchor)])
            codes.append(code[hit])
            places.append(at[hit])
            anchors += len(n)
        if not anchors:
            return _table([])
        start, row, anchor = (np.concatenate(x) for x in zip(*found))
        code, at = np.concatenate(codes), np.concatenate(places)
        content = contents(data, start, window)
        order = content_order(content)
        new = runs(content, order)
        first = np.flatnonzero(new)
        own = keys[row[order]]
        size = np.diff(np.append(first, len(order)))
        larger = own > np.repeat(np.minimum.reduceat(own, first), size)
        pairs = []
        gone = np.sort(order[larger])
        if len(gone):
            none = np.zeros(len(gone), np.uint8)
            pairs.append((groups + bucket, _places(keys, marks, row[gone], start[gone] - offsets[row[gone]], none)))
        run_of = np.repeat(np.arange(len(first)), size)[~larger]
        _, one, n = np.unique(run_of, return_index=True, return_counts=True)
        left = order[~larger][one]
        by_place = np.argsort(left)
        left, more = left[by_place], (n > 1)[by_place].astype(np.uint8)
        start, row, anchor = start[left].astype(np.int64), row[left], anchor[left]
        crowd = among(code, crowded)[anchor]
        group = (mixed(code) % np.uint64(groups)).astype(np.int64)[anchor]
        group[crowd] = (content_hashes(content[left[crowd]]) % np.uint64(groups)).astype(np.int64)
        # an anchor's windows that lie next to each other travel as one stretch; blocks may cut them
        joined = (np.diff(start) == 1) & (np.diff(at[anchor]) == 0) & ~crowd[1:] & ~crowd[:-1]
        head = np.flatnonzero(np.append(True, ~joined))
        count = np.diff(np.append(head, len(start)))
        for g, these in _by(group[head]):
            h, c = head[these], count[these]
            windows = np.repeat(h - (np.cumsum(c) - c), c) + np.arange(c.sum())
            wide = c + window - 1
            part = np.repeat(start[h] - (np.cumsum(wide) - wide), wide) + np.arange(wide.sum())
            pairs.append((g, _places(keys, marks, row[h], start[h] - offsets[row[h]], c.astype(np.uint32), more[windows], data[part])))
        return _table(pairs)

    return run


class Family:
    """Levels of sorted suffixes, each about twice the next; a window's suffixes all have its least document.

    ``add`` takes a batch and returns the ids of suffixes, new or held, that a smaller document holds too.
    """

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # contents, documents, ids

    def add(self, content: np.ndarray, doc: np.ndarray, ids: np.ndarray) -> np.ndarray:
        order = content_order(content)  # the batch's suffix array
        content, doc, ids = content[order], doc[order], ids[order]
        first = np.flatnonzero(np.append(True, content[1:] != content[:-1]))
        kept = doc == np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(doc))))
        out = [ids[~kept]]
        for i, (held, held_doc, held_ids) in enumerate(self.levels):  # merge-scan
            if not len(held):
                continue
            low = np.searchsorted(held, content, side="left")
            at = np.minimum(low, len(held) - 1)
            hit = kept & (held[at] == content)
            other = held_doc[at]
            early = hit & (doc < other)
            if early.any():
                high = np.searchsorted(held, content[early], side="right")
                change = np.zeros(len(held) + 1, np.int64)
                np.add.at(change, low[early], 1)
                np.add.at(change, high, -1)
                dead = np.cumsum(change[:-1]) > 0
                out.append(held_ids[dead])
                self.levels[i] = (held[~dead], held_doc[~dead], held_ids[~dead])
            late = hit & (doc > other)
            out.append(ids[late])
            kept &= ~late
        self.levels.append((content[kept], doc[kept], ids[kept]))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            low, high = self.levels.pop(), self.levels.pop()
            both = [np.concatenate(x) for x in zip(high, low)]
            order = np.argsort(both[0], kind="stable")  # two sorted runs: a merge
            self.levels.append(tuple(x[order] for x in both))
        return np.concatenate(out)


def group_marks(sent: DataFrame, window: int, groups: int, buckets: int) -> DataFrame:
    """(bucket, packed): marked suffixes of all groups, and those settled in buckets."""

    def run(table: pa.Table) -> pa.Table:
        target, values = table.column("target")[0].as_py(), table.column("packed").to_pylist()
        if target >= groups:
            return _table([(target - groups, v) for v in values]).rename_columns(["bucket", "packed"])
        family, batch, size, total = Family(), [], 0, 0
        keys, marks, rows, positions, more, gone = [], [], [], [], [], []
        row_base = 0

        def close() -> None:
            nonlocal batch, size, total
            content, doc = (np.concatenate(x) for x in zip(*batch))
            gone.append(family.add(content, doc, total + np.arange(len(doc))))
            total += len(doc)
            batch, size = [], 0

        for value in values:
            own_keys, own_marks, row, start, count, again, data = _unplaced(value)
            count = count.astype(np.int64)
            wide = count + window - 1
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(np.cumsum(wide) - wide, count) + step
            keys.append(own_keys)
            marks.append(own_marks)
            rows.append(row_base + np.repeat(row, count))
            positions.append(np.repeat(start, count) + step)
            more.append(again)
            batch.append((contents(data, at, window), own_keys[np.repeat(row, count)]))
            row_base += len(own_keys)
            size += len(at)
            if size >= BATCH:
                close()
        if size:
            close()
        gone = np.sort(np.concatenate(gone))
        keys, marks, rows, positions, more = (np.concatenate(x) for x in (keys, marks, rows, positions, more))
        rows, positions, more = rows[gone], positions[gone], more[gone]
        order = np.lexsort((positions, rows))
        rows, positions, more = rows[order], positions[order], more[order]
        home = (marks[rows] % buckets).astype(np.int64)
        return _table(
            [(b, _places(keys, marks, rows[at], positions[at], more[at])) for b, at in _by(home)]
        ).rename_columns(["bucket", "packed"])

    return sent.groupBy("target").applyInArrow(run, "bucket bigint, packed binary")


def _marked(rows: pa.Table, values: Sequence[bytes], offsets: np.ndarray, data: np.ndarray, window: int) -> np.ndarray:
    """Starts of all marked windows, as places in the bytes of the rows."""
    place = {m: i for i, m in enumerate(rows.column("__mark").to_pylist())}
    keys = rows.column("__key").to_pylist()
    starts, again = [np.empty(0, np.int64)], {}
    for value in values:
        _, marks, row, position, more = _unplaced(value)
        at = np.array([place[m] for m in marks.tolist()], np.int64)[row]
        start = offsets[at] + position
        starts.append(start)
        for i in np.flatnonzero(more).tolist():
            again.setdefault(keys[at[i]], []).append(start[i])
    for key, some in again.items():  # the same window elsewhere in its document
        wanted = np.unique(contents(data, np.array(some), window))
        for i in (i for i, k in enumerate(keys) if k == key):
            for low in range(offsets[i], offsets[i + 1] - window + 1, BLOCK):
                every = np.arange(low, min(low + BLOCK, offsets[i + 1] - window + 1))
                starts.append(every[among(contents(data, every, window), wanted)])
    return np.concatenate(starts)


def remove_repeated_bytes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """Removes bytes covered by a string of ``window`` bytes that also starts in a document with a smaller key.

    Returns ``key``, n_bytes, n_removed, n_spans, spans (first byte and end of every removed run, flat) and kept
    (the other bytes in order, binary). Strings are judged on the input and never cross documents;
    overlaps count. Keys are integers. A null text has no bytes; a row with a null key takes no part and loses
    nothing. Rows with the same key are the same document: they do not remove from each other, and each
    loses what smaller documents hold; repeated rows give repeated results. Texts count whole, however
    long. Other columns are ignored. An empty table gives an empty one.
    """
    size = docs.agg(F.sum(F.octet_length(named(text)).cast("bigint"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET))
    groups = max(1, -(-size // GROUP))
    anchors = size * 2 / (window - window // 2 + 2)
    anchor_groups = max(1, int(-(-anchors // ANCHORS)))
    crowd = max(CROWD, anchors / CROWDED)
    source = docs.select(
        named(key).cast("bigint").alias("__key"),
        named(text).alias("__text"),
        F.shiftrightunsigned(F.xxhash64(named(key).cast("bigint"), named(text)), 1).alias("__mark"),
    ).withColumn("__bucket", F.col("__mark") % buckets)
    sent = sent_anchors(source.filter("__key is not null"), window, anchor_groups, buckets)
    repeated = stored(repeated_anchors(sent, anchor_groups, buckets, crowd))
    crowded = [unpacked(r["packed"])[0] for r in repeated.filter("target = -1").collect()]
    crowded = np.sort(np.concatenate(crowded)) if crowded else np.empty(0, np.uint64)

    texts = packed_texts(source)
    flags = repeated.filter("target >= 0").select(F.col("target").alias("bucket"), "packed")
    suffixes = (
        texts.groupBy("bucket")
        .cogroup(flags.groupBy("bucket"))
        .applyInArrow(bucket_suffixes(window, anchor_groups, groups, crowded), "target bigint, packed binary")
    )
    marks = group_marks(suffixes, window, groups, buckets)

    def run(own: pa.Table, marked: pa.Table) -> pa.Table:
        if not own.num_rows:
            return schema.empty_table()
        rows = bucket_rows(own)
        offsets, data = text_bytes(rows.column("__text"))
        starts = _marked(rows, marked.column("packed").to_pylist(), offsets, data, window)
        change = np.zeros(len(data) + 1, np.int32)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + window, -1)
        covered = np.cumsum(change[:-1]) > 0
        spans = _spans(covered, offsets)
        sums = np.append(0, np.cumsum(~covered))
        ends = pa.array(sums[offsets], pa.int32())
        kept = pa.Array.from_buffers(
            pa.binary(), rows.num_rows, [None, ends.buffers()[1], pa.py_buffer(data[~covered].tobytes())]
        )
        n_bytes = np.diff(offsets)
        return pa.table(
            [
                rows.column("__key"),
                pa.array(n_bytes),
                pa.array(n_bytes - np.diff(sums[offsets])),
                pa.array(np.diff(spans.offsets.to_numpy()) // 2, pa.int64()),
                spans,
                kept,
                rows.column("__n"),
            ],
            schema=schema,
        )

    names = [key, "n_bytes", "n_removed", "n_spans", "spans", "kept", "__n"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64()]
    schema = pa.schema(list(zip(names, kinds)))
    found = (
        texts.groupBy("bucket")
        .cogroup(marks.groupBy("bucket"))
        .applyInArrow(
            run,
            f"`{key}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<bigint>, "
            "kept binary, __n bigint",
        )
    )
    # rows that were alike travelled once
    return found.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")
