"""Source divergences against plain Python with whole numbers."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

from panelcast.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
FIELDS = "doc_id bigint, text string, lang string, source string"


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, min_docs, top):
    counts, docs, groups = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = collections.Counter(TERM.findall(lowered(text)))
        for t, n in found.items():
            counts[lang, source, t] += n
            docs[lang, t] += 1
    out = []
    for lang, sources in groups.items():
        kept = [t for (x, t), n in docs.items() if x == lang and n >= min_docs]
        v = len(kept)
        total = {s: sum(counts[lang, s, t] for t in kept) for s in sources}

        def share(n, of):
            return 1 + 1_000_000_000 * (n + 5) // (of + 5 * v)

        for s in sources:
            pairs = [
                (-sum(abs(share(counts[lang, s, t], total[s]) - share(counts[lang, o, t], total[o])) for t in kept), o)
                for o in sources if o != s
            ]
            terms = []
            for t in kept:
                q = share(sum(counts[lang, o, t] for o in sources), sum(total.values()))
                p = share(counts[lang, s, t], total[s])
                if counts[lang, s, t] and p > q:
                    terms.append((q - p, t))
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, i, -f, k) for k, (f, i) in enumerate(items[:most], 1)]
    return sorted(out)


def sample(n, seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("be", "Da", "éx", "ß", "日本", "zo") for b in ("", "ra", "LU", "tin")]
    seps = [" ", "  ", "-", "7", "\n", "\x00", "_", "'", "\t", "."]
    rows = []
    for i in range(n):
        s = "hot" if rng.random() < 0.4 else f"s{rng.randrange(4)}"
        lang = rng.choice(["en", "en", "de", None])
        text = "".join(rng.choice(words[: 8 + 4 * (len(s) % 3)]) + rng.choice(seps) for _ in range(rng.randrange(30)))
        rows.append((i, text, lang, s))
    rows += [(9000, None, "en", None), (9001, "", "", "s1"), (9002, "1 2 3", "xx", "s1"), (9003, None, "xx", "s2")]
    rows += [(9004, "ra " * 5000, "en", "s1"), (9004, "ra " * 5000, "en", "s1"), (9005, "  x", "yy", "alone")]
    return rows


@pytest.mark.parametrize("flush, cells, shard", [(1 << 20, 1 << 20, 1 << 25), (20, 12, 300)])
def test_against_brute_force(spark, monkeypatch, flush, cells, shard):
    monkeypatch.setattr(divergence, "FLUSH_ROWS", flush)
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "SHARD_BYTES", shard)
    rows = sample(300, 3)
    frame = spark.createDataFrame(rows, FIELDS).repartition(5)
    for min_docs, top in ((3, 4), (30, 50)):
        found = divergence.source_divergence(frame, min_docs=min_docs, top=top)
        assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, found.collect())) == brute(rows, min_docs, top)


def test_empty_table_and_clashing_columns(spark):
    frame = spark.createDataFrame(
        [(1, "a b", "en", "x", "p", 1), (2, "a c", "en", "y", "q", 2)], FIELDS + ", part string, rank int"
    )
    found = divergence.source_divergence(frame, min_docs=1).collect()
    assert sorted(map(tuple, found)) == brute([(1, "a b", "en", "x"), (2, "a c", "en", "y")], 1, 50)
    assert divergence.source_divergence(frame.limit(0)).count() == 0


def test_shares_are_exact_for_large_totals():
    rng = random.Random(1)
    total = [rng.randrange(1, 9 * 10**15) for _ in range(500)] + [1, 7]
    counts = [rng.randrange(t + 1) for t in total]
    got = divergence.shares(np.array(counts), np.array(total))
    assert got.tolist() == [1 + 10**9 * n // t for n, t in zip(counts, total)]
