"""Alignment of two tokenizers' tokens over the same bytes, by interval coalescing.

Tokens of both vocabularies are byte intervals over one text. All intervals are sorted by start, the
running maximum of their ends is accumulated, and a group breaks where a start reaches it: there
tokens of both end. Overlaps of A and B tokens expand inside the groups to links.

No token of either vocabulary crosses a blank between two characters that are not white space (checked
for B when its file is read; A's pattern starts a new token there). So a text is cut at such
blanks, every different part is encoded and aligned once, many parts in one pass, and kept in a
table of bounded size. A text's own result is put together from its parts.

How often an id pair occurs is counted over the whole corpus, so the work has two passes with a table
between them: texts to counts and different linked pairs per text; pair counts by a shuffle of
partial counts; then every text's pairs meet their counts. The commonest pairs, at most ``HOT``, travel to
all tasks; every other pair goes to its count by a join, in which no pair is crowded. Nothing is left out.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from panelcast.functions.expressions import named
from panelcast.llm.pieces import MARK, Pieces, _shipped
from panelcast.llm.substring_dedup import pack, unpack
from panelcast.llm.text import filled, map_texts, row_of
from panelcast.operators.lineage import stored

HOT = 1 << 19  # id pairs whose counts travel to all tasks, 17 bytes each
TABLE_PARTS = 250_000  # aligned parts kept per task
TABLE_CHARS = 1 << 22
PARTIAL_PAIRS = 1 << 21  # pairs a task counts before it sends
CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_values() -> dict[str, int]:
    """The character a byte-level vocabulary writes for each byte: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Aligner:
    """Both vocabularies, and how many bytes an entry stands for, by id."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        with open(a_path) as file:
            parsed = json.load(file)
        pre = parsed["pre_tokenizer"] or {}
        if parsed["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
            raise ValueError("A must be a byte-level vocabulary that splits words and changes no text")
        Pieces(b_path)  # checks that no piece crosses a blank
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        values = byte_values()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        if not all(c in vocabulary for c in values):
            raise ValueError("A must have an entry for every byte")
        # an entry has a character per byte
        self.a_size = np.ones(max(self.a.get_vocab().values()) + 1, np.int64)
        self.a_size[list(vocabulary.values())] = [len(entry) for entry in vocabulary]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_size = np.array(
            [1 if self.b.is_byte(i) else len(p.replace(MARK, " ").encode()) for i, p in enumerate(pieces)]
        )
        self.a_names = [str(i) for i in range(len(self.a_size))]
        self.b_names = [str(i) for i in range(len(self.b_size))]
        self.batch = getattr(self.a, "encode_batch_fast", self.a.encode_batch)

    def encoded(self, parts: Sequence[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and numbers of ids per part: of A, with a blank in front, and of B, which adds it."""
        a = [e.ids for e in self.batch([" " + p for p in parts], add_special_tokens=False)]
        b = self.b.encode(list(parts), num_threads=1)
        sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b)]
        ids = [np.fromiter(chain.from_iterable(x), np.int64, n.sum()) for x, n in zip((a, b), sizes)]
        return ids, sizes


def coalesced(start: np.ndarray, end: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): intervals by start, and the group of each; a group ends where a start reaches
    the running maximum of the ends."""
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    return order, np.cumsum(np.append(True, start[order][1:] >= reach[:-1])) - 1


def overlaps(a_start, a_end, b_start, b_end) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of overlapping A and B intervals, by index; both lists cover the same bytes in order."""
    first = np.searchsorted(b_end, a_start, side="right")
    count = np.searchsorted(b_start, a_end, side="left") - first
    a = np.repeat(np.arange(len(a_start)), count)
    return a, np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(a))


class PartTable:
    """Aligned parts of texts: counts, groups as text, and different linked pairs with how often."""

    def __init__(self, aligner: Aligner) -> None:
        self.aligner = aligner
        self.b_ids = len(aligner.b_size)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        self.same = np.empty(0, bool)
        self.counts = np.empty((0, 4), np.int64)  # A tokens, B tokens, groups, links
        self.starts = np.zeros(1, np.int64)
        self.pairs = np.empty(0, np.int64)
        self.times = np.empty(0, np.int64)
        self.seen = np.empty(0, np.int64)

    def thin(self) -> None:
        """Keeps the parts seen twice or more since the table was thinned, all gone if that is most of them."""
        keep = np.flatnonzero(self.seen > 1)
        texts = list(self.index)
        if 2 * len(keep) > TABLE_PARTS or 2 * sum(len(texts[i]) for i in keep.tolist()) > TABLE_CHARS:
            self.clear()
            return
        size = np.diff(self.starts)[keep]
        at = np.repeat(self.starts[keep] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        self.index = {texts[i]: n for n, i in enumerate(keep.tolist())}
        self.chars = sum(map(len, self.index))
        self.groups = [self.groups[i] for i in keep.tolist()]
        self.same, self.counts = self.same[keep], self.counts[keep]
        self.starts = np.append(0, np.cumsum(size))
        self.pairs, self.times = self.pairs[at], self.times[at]
        self.seen = np.zeros(len(keep), np.int64)

    def codes(self, parts: Sequence[str]) -> np.ndarray:
        """The number of every part; parts not seen yet are aligned."""
        index, known = self.index, len(self.index)
        found = np.array([index.setdefault(p, len(index)) for p in parts], np.int64)
        if len(index) > known:
            new = list(islice(index, known, None))
            self.chars += sum(map(len, new))
            self._add(new)
        self.seen += np.bincount(found, minlength=len(self.seen))
        return found

    def full(self) -> bool:
        return len(self.index) >= TABLE_PARTS or self.chars >= TABLE_CHARS

    def _add(self, parts: Sequence[str]) -> None:
        al = self.aligner
        (a_ids, b_ids), (a_len, b_len) = al.encoded(parts)
        whole = np.fromiter((len(p.encode()) + 1 for p in parts), np.int64, len(parts))
        # neither vocabulary rewrites text but for the mark of blanks, so bytes are as many only if they are the same
        same = np.ones(len(parts), bool)
        for ids, n, size in ((a_ids, a_len, al.a_size), (b_ids, b_len, al.b_size)):
            same &= np.bincount(np.repeat(np.arange(len(parts)), n), weights=size[ids], minlength=len(parts)) == whole
        good = np.flatnonzero(same)
        a_ids, b_ids = a_ids[np.repeat(same, a_len)], b_ids[np.repeat(same, b_len)]
        a_len, b_len = a_len[good], b_len[good]
        a_end, b_end = np.cumsum(al.a_size[a_ids]), np.cumsum(al.b_size[b_ids])
        a_start, b_start = a_end - al.a_size[a_ids], b_end - al.b_size[b_ids]
        a_part, b_part = row_of(np.append(0, np.cumsum(a_len))), row_of(np.append(0, np.cumsum(b_len)))
        side = np.repeat([0, 1], [len(a_ids), len(b_ids)])
        start, end, part = (np.concatenate(x) for x in ((a_start, b_start), (a_end, b_end), (a_part, b_part)))
        order, group = coalesced(start, end, side)
        breaks = np.diff(group, prepend=-1) > 0
        counts = np.zeros((len(parts), 4), np.int64)
        texts = [""] * len(parts)
        if len(good):
            counts[good, 0], counts[good, 1] = a_len, b_len
            counts[good, 2] = np.bincount(part[order][breaks], minlength=len(good))
            # by group A ids, then B ids: , inside a side, | between sides, ; between groups
            at = order[np.lexsort((start[order], side[order], group))]
            member = np.empty(len(order), np.int64)
            member[order] = group
            g, s, p = member[at], side[at], part[at]
            mark = np.full(len(at), ",", dtype=object)
            mark[:-1][s[1:] != s[:-1]] = "|"
            mark[:-1][g[1:] != g[:-1]] = ";"
            mark[:-1][p[1:] != p[:-1]] = "\n"
            mark[-1] = ""
            names = [al.a_names[i] for i in a_ids.tolist()] + [al.b_names[i] for i in b_ids.tolist()]
            woven = [""] * (2 * len(at))
            woven[0::2] = [names[i] for i in at.tolist()]
            woven[1::2] = mark.tolist()
            for i, text in zip(good.tolist(), "".join(woven).split("\n")):
                texts[i] = text
        x, y = overlaps(a_start, a_end, b_start, b_end)
        pair = a_ids[x] * self.b_ids + b_ids[y]
        of = good[a_part[x]] if len(x) else np.empty(0, np.int64)
        counts[:, 3] = np.bincount(of, minlength=len(parts))
        order = np.lexsort((pair, of))
        pair, of = pair[order], of[order]
        first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (of[1:] != of[:-1]))) if len(pair) else of
        self.starts = np.append(
            self.starts, self.starts[-1] + np.cumsum(np.bincount(of[first], minlength=len(parts)))
        )
        self.pairs = np.append(self.pairs, pair[first])
        self.times = np.append(self.times, np.diff(np.append(first, len(pair))))
        self.groups += texts
        self.counts = np.concatenate([self.counts, counts])
        self.same = np.append(self.same, same)
        self.seen = np.append(self.seen, np.zeros(len(parts), np.int64))

    def linked(self, text: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times): different pairs of every text and how often they are linked there, in
        order of text and pair, from the parts of the texts."""
        parts = len(self.index)
        once, n = np.unique(text * parts + part, return_counts=True)
        text, part = once // parts, once % parts
        size = self.starts[part + 1] - self.starts[part]
        at = np.repeat(self.starts[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        text, pair, times = np.repeat(text, size), self.pairs[at], self.times[at] * np.repeat(n, size)
        order = np.lexsort((pair, text))
        text, pair, times = text[order], pair[order], times[order]
        if not len(text):
            return text, pair, times
        first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])))
        return text[first], pair[first], np.add.reduceat(times, first)


@functools.lru_cache(maxsize=2)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _aligned(table: PartTable, texts: pa.Array, digests: bool):
    """Counts, groups and packed links of a slice of texts."""
    if table.full():
        table.thin()
    cut = [CUT.split(t) if t else [] for t in filled(texts).to_pylist()]
    sizes = np.array([len(c) for c in cut], np.int64)
    flat = table.codes([p for c in cut for p in c])
    text = np.repeat(np.arange(len(cut)), sizes)
    bad = np.zeros(len(cut), bool)
    bad[text[~table.same[flat]]] = True
    keep = ~bad[text]
    flat, text = flat[keep], text[keep]
    counts = np.zeros((len(cut), 4), np.int64)
    np.add.at(counts, text, table.counts[flat])
    ends = np.searchsorted(text, np.arange(len(cut) + 1))
    codes, groups = flat.tolist(), []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        joined = ";".join([table.groups[c] for c in codes[a:b]])
        groups.append(hashlib.sha256(joined.encode()).hexdigest() if digests and joined else joined)
    text, pair, times = table.linked(text, flat)
    ends = np.searchsorted(text, np.arange(len(cut) + 1))
    links = [
        pack(np.diff(pair[a:b], prepend=0).astype(np.uint64), times[a:b].astype(np.uint32)) if b > a else b""
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())
    ]
    return (*[pa.array(c) for c in counts.T], groups, pa.array(links, pa.binary()))


def _links(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, pair and times of all packed links of a batch."""
    rows, pairs, times = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for row, value in enumerate(column.to_pylist()):
        if value:
            step, n = unpack(value)
            rows.append(np.full(len(step), row, np.int64))
            pairs.append(np.cumsum(step).astype(np.int64))
            times.append(n.astype(np.int64))
    return np.concatenate(rows), np.concatenate(pairs), np.concatenate(times)


def pair_counts(aligned: DataFrame, b_ids: int) -> DataFrame:
    """(pair, n, best): in how many texts an id pair is linked, and whether no pair of its A id is in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0

        def sent() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            held.append(_links(batch.column(0))[1])
            many += len(held[-1])
            if many >= PARTIAL_PAIRS:
                yield sent()
                held, many = [], 0
        if many:
            yield sent()

    partial = aligned.select("__links").mapInArrow(run, "pair bigint, n bigint")
    counted = partial.groupBy("pair").agg(F.sum("n").alias("n"))
    # an A id has as many pairs as B has ids, at most
    of_a = Window.partitionBy(F.expr(f"pair div {b_ids}"))
    return counted.withColumn("best", F.col("n") == F.max("n").over(of_a))


def commonest(counts: DataFrame, most: int) -> pa.Table:
    """Pairs in the most texts, at most ``most`` of them: all whose count reaches a power of two."""
    power = F.floor(F.log2("n")).cast("int")
    bins = {r["k"]: r["m"] for r in counts.groupBy(power.alias("k")).agg(F.count("*").alias("m")).collect()}
    least, total = 64, 0
    while least > 0 and total + bins.get(least - 1, 0) <= most:
        least -= 1
        total += bins.get(least, 0)
    return counts.filter(power >= least).toArrow().sort_by("pair")


def align_tokens(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    key: str = "doc_id",
    text: str = "text",
    keep: Sequence[str] = (),
    digests: bool = False,
    hot: int = HOT,
) -> DataFrame:
    """Aligns the tokens of every whole text under a byte-level (A) and a piece vocabulary (B).

    Returns ``key``, ``keep``, n_a and n_b (tokens), n_groups, n_links (overlapping A-B occurrences), n_best
    (links whose id pair is in as many texts as any pair of its A id), count_sum (that number summed over
    links) and groups (``a1,a2|b1;a3|b2``: ids of A, then B, per group), or with ``digests`` its SHA-256.

    Both see a blank in front of the text. A text that is null or empty, or whose tokens of A or B do not
    give its bytes again (a literal U+2581), has no tokens: zeros and empty groups. Every row is a text, so repeated
    rows count repeatedly; a null key is kept. Long texts are whole. Columns of ``keep`` named like a new
    column are dropped. An empty table gives an empty one.
    """
    a_name, b_name = (_shipped(docs.sparkSession, p) for p in (a_path, b_path))
    groups = "groups_sha256" if digests else "groups"

    def work():
        table = PartTable(_aligner(SparkFiles.get(a_name), SparkFiles.get(b_name)))
        return lambda texts: _aligned(table, texts, digests)

    counts = ["n_a", "n_b", "n_groups", "n_links"]
    added = [*[(c, T.LongType()) for c in counts], (groups, T.StringType()), ("__links", T.BinaryType())]
    new = {*counts, groups, "n_best", "count_sum"}
    keep = [c for c in dict.fromkeys(keep) if c not in new and c != key]
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    aligned = stored(map_texts(numbered, key, text, added, work, [*keep, "__row"]))
    b_ids = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    counted = stored(pair_counts(aligned, b_ids))
    top = commonest(counted, hot)
    known = docs.sparkSession.sparkContext.broadcast(
        tuple(top.column(c).to_numpy() for c in ("pair", "n", "best"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = known.value
        for batch in batches:
            row, pair, times = _links(batch.column("__links"))
            at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            hit = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            at, rest = at[hit], ~hit
            own, often = row[hit], times[hit]
            sums = np.zeros((2, len(batch)), np.int64)
            np.add.at(sums[0], own, often * best[at])
            np.add.at(sums[1], own, often * n[at])
            ends = pa.array(np.append(0, np.cumsum(np.bincount(row[rest], minlength=len(batch)))), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[rest])) for x in (pair, times)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__row"), *[pa.array(x) for x in sums], *lists],
                names=["__row", "best", "total", "pair", "times"],
            )

    met = stored(
        aligned.select("__row", "__links").mapInArrow(
            run, "__row bigint, best bigint, total bigint, pair array<bigint>, times array<bigint>"
        )
    )
    rest = met.select("__row", F.explode(F.arrays_zip("pair", "times")).alias("x")).select("__row", "x.*")
    rest = rest.join(counted, "pair").select(
        "__row", (F.col("times") * F.col("best").cast("bigint")).alias("best"), (F.col("times") * F.col("n")).alias("total")
    )
    sums = met.select("__row", "best", "total").union(rest).groupBy("__row")
    sums = sums.agg(F.sum("best").alias("n_best"), F.sum("total").alias("count_sum"))
    joined = aligned.drop("__links").join(sums, "__row")
    return joined.select(*[named(c) for c in [key, *keep, *counts]], "n_best", "count_sum", groups)
