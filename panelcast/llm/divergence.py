"""How far the sources of a language differ in their use of words: an Arrow pipeline over term counts.

A term is a run of letters A-Z, a-z or of characters from U+0080 on, with A-Z lower-cased. Three steps:

* Inside ``mapInArrow`` every slice is lower-cased, split by a pattern, dictionary-encoded and counted by
  Arrow's hash grouping, per (row, term) and then per (language, source, term). A task merges the
  counts of its slices and sends them as compressed columns, dealt to shards by a hash of the term.
* A shard holds all counts of its terms. It merges the columns, keeps the terms found in enough documents
  of a language and stores them per language with its part of the totals.
* With the totals of a language every stored block gives its part of the differences between sources,
  and the terms a source uses most beyond its language.

Shares are whole numbers, 1 + floor(SCALE (count + SMOOTH) / (N + SMOOTH V)). They are found by long
division in steps of 1,000, exact in 64 bits while N + SMOOTH V stays below 9.2e15. What a shard
holds is bounded by its terms and sources, not by documents: a source or language with a third of all rows
shrinks to one count per term in every task. All pairs of sources of a language are the result itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.expressions import named
from panelcast.llm.text import filled, slices, word_hashes
from panelcast.operators.lineage import attach_facts, stored

BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"  # what separates terms
SCALE = 1_000_000_000
SMOOTH = 5
MIN_DOCS = 30
TOP = 50
SHARD_BYTES = 1 << 25  # text whose counts make up one shard
FLUSH_ROWS = 1 << 20  # counts a task merges before it sends
CELLS = 1 << 20  # shares of a block formed at once

COUNTS = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())]
)


def slice_counts(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """Counts of the terms of a slice, and of the rows that hold them, per language and source."""
    lists = pc.split_pattern_regex(pc.ascii_lower(filled(text)), pattern=BETWEEN)
    terms, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.not_equal(terms, "")
    coded = terms.filter(real).dictionary_encode()
    once = pa.table({"row": rows.filter(real), "term": coded.indices}).group_by(
        ["row", "term"], use_threads=False
    ).aggregate([([], "count_all")])
    row = once.column("row")
    langs, sources = filled(lang).dictionary_encode(), filled(source).dictionary_encode()
    found = pa.table(
        {
            "lang": langs.indices.take(row),
            "source": sources.indices.take(row),
            "term": once.column("term"),
            "n": once.column("count_all"),
        }
    ).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ([], "count_all")])
    return pa.table(
        [
            langs.dictionary.take(found.column("lang")),
            sources.dictionary.take(found.column("source")),
            coded.dictionary.take(found.column("term")),
            found.column("n_sum"),
            found.column("count_all"),
        ],
        schema=COUNTS,
    )


def merge_counts(tables: list[pa.Table]) -> pa.Table:
    """One count per language, source and term."""
    found = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False).aggregate(
        [("n", "sum"), ("docs", "sum")]
    )
    return pa.table([found.column(c) for c in ("lang", "source", "term", "n_sum", "docs_sum")], schema=COUNTS)


def packed(table: pa.Table) -> bytes:
    """Columns as one compressed value; repeated strings are coded."""
    coded = pa.table(
        {
            c: table.column(c).combine_chunks().dictionary_encode()
            if c in ("lang", "source") and c in table.column_names
            else table.column(c).combine_chunks()
            for c in table.column_names
        }
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, coded.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(coded)
    return sink.getvalue().to_pybytes()


def unpacked(value: bytes) -> pa.Table:
    table = pa.ipc.open_stream(value).read_all()
    return table.cast(
        pa.schema([(f.name, pa.string() if pa.types.is_dictionary(f.type) else f.type) for f in table.schema])
    )


def partial_counts(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, packed): merged counts of every task, by shard of the term. ``docs``: lang, source, text."""

    def sent(table: pa.Table) -> Iterator[pa.RecordBatch]:
        coded = table.column("term").combine_chunks().dictionary_encode()
        shard = (word_hashes(coded.dictionary) % np.uint64(shards)).astype(np.int64)
        own = shard[coded.indices.to_numpy()]
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.diff(own[order], prepend=-1))
        for rows in np.split(order, first[1:]):
            values = pa.array([packed(table.take(pa.array(rows)))], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(own[rows[:1]]), values], ["shard", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                held.append(slice_counts(*[part.column(c) for c in ("lang", "source", "text")]))
                rows += held[-1].num_rows
                if rows >= FLUSH_ROWS:
                    held = [merge_counts(held)]
                    rows = held[0].num_rows
                    if 2 * rows >= FLUSH_ROWS:  # little falls together any more
                        yield from sent(held[0])
                        held, rows = [], 0
        if rows:
            yield from sent(merge_counts(held))

    return docs.mapInArrow(run, "shard bigint, packed binary")


def kept_blocks(partial: DataFrame, min_docs: int) -> DataFrame:
    """(lang, block, v, sources, sums) per shard and language: kept terms and their part of the totals."""

    def run(table: pa.Table) -> pa.Table:
        counts = merge_counts([unpacked(v) for v in table.column("packed").to_pylist()])
        terms = counts.group_by(["lang", "term"], use_threads=False).aggregate([("docs", "sum")])
        terms = terms.filter(pc.greater_equal(terms.column("docs_sum"), min_docs)).select(["lang", "term"])
        kept = counts.join(terms, ["lang", "term"], join_type="inner", use_threads=False)
        out = []
        for lang in pc.unique(kept.column("lang")).to_pylist():
            own = kept.filter(pc.equal(kept.column("lang"), lang)).select(["source", "term", "n"])
            sums = own.group_by("source", use_threads=False).aggregate([("n", "sum")])
            out.append(
                {
                    "lang": lang,
                    "block": packed(own),
                    "v": len(pc.unique(own.column("term"))),
                    "sources": sums.column("source").to_pylist(),
                    "sums": sums.column("n_sum").to_pylist(),
                }
            )
        return pa.Table.from_pylist(out, schema)

    schema = pa.schema(
        [("lang", pa.string()), ("block", pa.binary()), ("v", pa.int64()),
         ("sources", pa.list_(pa.string())), ("sums", pa.list_(pa.int64()))]
    )
    return partial.groupBy("shard").applyInArrow(
        run, "lang string, block binary, v bigint, sources array<string>, sums array<bigint>"
    )


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE counts / total), by long division in steps of 1,000."""
    whole, rest = np.divmod(counts, total)
    scale = SCALE
    while scale > 1:
        digit, rest = np.divmod(rest * 1000, total)
        whole, scale = whole * 1000 + digit, scale // 1000
    return 1 + whole


def block_differences(
    block: pa.Table, sources: list[str], sums: list[int], v: int, top: int
) -> tuple[np.ndarray, list[tuple[str, str, int]]]:
    """Differences between all pairs of sources summed over a block's terms, and the leading terms
    (source, term, difference to the language) per source."""
    place = {s: i for i, s in enumerate(sources)}
    total = np.maximum(np.array(sums, np.int64) + SMOOTH * v, 1)  # 0 only where there are no terms
    every = np.int64(max(sum(sums) + SMOOTH * v, 1))
    coded = block.column("term").combine_chunks().dictionary_encode()
    owner = block.column("source").combine_chunks().dictionary_encode()
    col = np.array([place[s] for s in owner.dictionary.to_pylist()], np.int64)[owner.indices.to_numpy()]
    row, n = coded.indices.to_numpy().astype(np.int64), block.column("n").to_numpy()
    terms = coded.dictionary
    all_n = np.zeros(len(terms), np.int64)
    np.add.at(all_n, row, n)
    none = shares(np.full(len(sources), SMOOTH, np.int64), total)
    own, language = shares(n + SMOOTH, total[col]), shares(all_n + SMOOTH, every)
    apart = np.zeros((len(sources), len(sources)), np.int64)
    step = max(1, CELLS // len(sources))
    order = np.argsort(row, kind="stable")
    cuts = np.searchsorted(row[order], np.arange(0, len(terms) + step, step))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        cells = np.tile(none, (min(step, len(terms) - k * step), 1))
        part = order[a:b]
        cells[row[part] - k * step, col[part]] = own[part]
        for s in range(len(sources)):
            apart[s] += np.abs(cells - cells[:, s : s + 1]).sum(axis=0)
    over = np.flatnonzero((n > 0) & (own > language[row]))
    found = pa.table(
        {"source": col[over], "f": own[over] - language[row[over]], "term": terms.take(pa.array(row[over]))}
    )
    # strings are compared byte by byte
    found = found.take(pc.sort_indices(found, [("source", "ascending"), ("f", "descending"), ("term", "ascending")]))
    of = found.column("source").to_numpy()
    lead = np.arange(len(of)) - np.searchsorted(of, of) < top
    found = found.filter(pa.array(lead))
    leading = zip(found.column("source").to_pylist(), found.column("term").to_pylist(), found.column("f").to_pylist())
    return apart, [(sources[s], t, f) for s, t, f in leading]


def source_divergence(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    min_docs: int = MIN_DOCS,
    top: int = TOP,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how a source's words differ from others of its language.

    Part ``pair``: item is another source of the language, value the sum over all kept terms of the
    difference of their shares; every other source is listed. Part ``term``: item is a term that the source
    uses and whose share there is above the language's, value that difference; the ``top`` first.
    Rank counts from 1 per language, source and part, by value descending, then item (UTF-8) ascending.

    Null texts, languages and sources count as empty strings. Every row is a document, so repeated rows
    count repeatedly; texts count whole, however long. A language without kept terms gives pairs of value 0.
    Other columns are ignored, and the result has its own names only. An empty table gives an empty one.
    """
    own = docs.select(
        *[F.coalesce(named(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]
    )
    size = own.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    blocks = stored(kept_blocks(partial_counts(own, shards), min_docs))
    groups = own.select("lang", "source").distinct()
    sums = blocks.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("x"))
    sums = sums.groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.sums").alias("n"))
    kept = blocks.groupBy("lang").agg(F.sum("v").alias("v"))
    # one row per language with its sources and their totals
    totals = (
        groups.join(sums, ["lang", "source"], "left")
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("own"))
        .join(kept, "lang", "left")
        .select("lang", F.col("own.source").alias("names"), F.col("own.n").alias("totals"), F.coalesce("v", F.lit(0)).alias("v"))
    )
    totals = stored(totals)
    every = blocks.select("lang", "block").union(totals.select("lang", F.lit(None).cast("binary")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = pa.table({"source": pa.array([], pa.string()), "term": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        for batch in batches:
            for r in batch.to_pylist():
                block = unpacked(r["block"]) if r["block"] else empty
                names = r["names"]
                apart, leading = block_differences(block, names, r["totals"], r["v"], top)
                for i, s in enumerate(names):  # one source's pairs at a time
                    others = [j for j in range(len(names)) if j != i]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "lang": [r["lang"]] * len(others),
                            "source": [s] * len(others),
                            "part": ["pair"] * len(others),
                            "item": [names[j] for j in others],
                            "value": apart[i][others],
                        },
                        schema=schema,
                    )
                for a in range(0, len(leading), FLUSH_ROWS):
                    some = leading[a : a + FLUSH_ROWS]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "lang": [r["lang"]] * len(some),
                            "source": [x[0] for x in some],
                            "part": ["term"] * len(some),
                            "item": [x[1] for x in some],
                            "value": [x[2] for x in some],
                        },
                        schema=schema,
                    )

    schema = pa.schema(
        [("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())]
    )
    found = attach_facts(every, totals, ["lang"], "inner", stored=True).select("lang", "block", "names", "totals", "v")
    found = found.mapInArrow(run, "lang string, source string, part string, item string, value bigint")
    found = stored(found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    pairs = found.filter("part = 'pair'").select("*", rank)
    terms = found.filter("part = 'term'").select("*", rank).filter(F.col("rank") <= top)
    return pairs.union(terms)
