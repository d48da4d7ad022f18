"""Aligned tokens against a plain walk over the libraries' own tokens of whole texts."""

from __future__ import annotations

import collections
import hashlib
import random

import pytest
import sentencepiece
from tokenizers import Tokenizer

from panelcast.llm import alignment
from panelcast.llm.queries import piece_model, vocabulary

A_PATH, B_PATH = vocabulary("byte_bpe_50k.json"), piece_model()
VALUES = alignment.byte_values()


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def spans(sizes):
    out, at = [], 0
    for n in sizes:
        out.append((at, at + n))
        at += n
    return out


def brute(rows, libraries):
    a, b = libraries
    names = {i: t for t, i in a.get_vocab().items()}
    per_text = []
    for d, text in rows:
        whole = (" " + (text or "")).encode()
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text, num_threads=1) if text else []
        xb = [bytes(VALUES[c] for c in names[i]) for i in x]
        yb = [
            bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
            for i in y
        ]
        if not text or b"".join(xb) != whole or b"".join(yb) != whole:
            per_text.append((d, 0, 0, "", []))
            continue
        xs, ys = spans(map(len, xb)), spans(map(len, yb))
        links, j = [], 0
        for i, (s, e) in enumerate(xs):
            while ys[j][1] <= s:
                j += 1
            k = j
            while k < len(ys) and ys[k][0] < e:
                links.append((x[i], y[k]))
                k += 1
        ends = {e for _, e in xs} & {e for _, e in ys}
        groups, left, right = [], iter(zip(x, xs)), iter(zip(y, ys))
        for end in sorted(ends):
            sides = []
            for source in (left, right):
                ids = []
                for i, (_, e) in source:
                    ids.append(str(i))
                    if e == end:
                        break
                sides.append(",".join(ids))
            groups.append("|".join(sides))
        per_text.append((d, len(x), len(y), ";".join(groups), links))
    held = collections.Counter(p for *_, links in per_text for p in set(links))
    most = collections.Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return sorted(
        [
            (d, n_a, n_b, g.count(";") + 1 if g else 0, len(links), sum(held[p] == most[p[0]] for p in links),
             sum(held[p] for p in links), g)
            for d, n_a, n_b, g, links in per_text
        ],
        key=str,
    )


def odd_texts(seed, n):
    rng = random.Random(seed)
    bits = ["a", "the", "é", "日本", "😀", " ", "  ", "\n", "\t", " ", " ", "\x1c", "\u0085", "'s", "1", "23",
            "<s>", "<|endoftext|>", "​", "\x00", "--", "Ünd", " ing", "é", "᠎", "﻿"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("hot, partial, parts", [(1 << 19, 1 << 21, 150_000), (300, 500, 40), (0, 1 << 21, 150_000)])
def test_against_whole_texts(spark, sf, libraries, monkeypatch, hot, partial, parts):
    monkeypatch.setattr(alignment, "PARTIAL_PAIRS", partial)
    monkeypatch.setattr(alignment, "TABLE_PARTS", parts)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = docs if hot else docs[:40]
    rows = rows + [(10_000 + i, t) for i, t in enumerate(odd_texts(5, 300))]
    rows += [(1, None), (2, ""), (3, " "), (4, "a▁b and more"), (None, "the the"), (5, "x y"), (5, "x y"), (6, "ab" * 40_000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = alignment.align_tokens(frame, A_PATH, B_PATH, hot=hot)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert sorted([tuple(r) for r in found.collect()], key=str) == brute(rows, libraries)


def test_digests_empty_table_and_clashing_columns(spark):
    rows = [(1, "some words", "x", 7), (2, None, "y", 8)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, n_a string, __rowish int")
    plain = {r["doc_id"]: r["groups"] for r in alignment.align_tokens(frame, A_PATH, B_PATH).collect()}
    found = alignment.align_tokens(frame, A_PATH, B_PATH, keep=["n_a", "__rowish", "doc_id"], digests=True)
    assert found.columns[:2] == ["doc_id", "__rowish"] and found.columns.count("n_a") == 1
    got = {r["doc_id"]: r for r in found.collect()}
    assert got[1]["groups_sha256"] == hashlib.sha256(plain[1].encode()).hexdigest() and got[2]["groups_sha256"] == ""
    assert got[1]["n_a"] > 0 and got[2]["n_a"] == 0
    assert alignment.align_tokens(frame.limit(0), A_PATH, B_PATH).count() == 0


def test_commonest_pairs_are_bounded(spark):
    counts = spark.range(1, 2000).selectExpr("id as pair", "id as n", "true as best")
    assert alignment.commonest(counts, 1000).num_rows == 1999 - 1023
    assert alignment.commonest(counts, 10).num_rows == 0
    assert alignment.commonest(counts, 5000).num_rows == 1999
