"""Piece encoding against the public library, and its defined cases."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

sentencepiece = pytest.importorskip("sentencepiece")

from panelcast.llm import pieces  # noqa: E402
from panelcast.llm.queries import piece_model  # noqa: E402


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.Pieces(piece_model()))


def test_random_texts_encode_and_decode_like_the_library(library, encoder):
    rng = random.Random(0)
    letters = "  ▁ab\n\tcdetheingAB01.,é日本\x00𝕏ß-"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        ids = library.encode(text)
        assert encoder.encode(text) == ids
        assert encoder.decode_text(ids) == library.decode(ids)


def test_long_runs(library, encoder):
    for n in (1, 7, 16, 17, 33, 300):
        for text in (" " * n, "a" * n, "ab" * n, "=" * n, " " * n + "x"):
            assert encoder.encode(text) == library.encode(text)


def test_merging_a_piece_pair_decides_compatibility(encoder):
    ids = encoder.pieces.ids
    assert not encoder.fits(ids["t"], ids["h"])  # would merge
    assert encoder.fits(ids["▁the"], ids["▁the"])


def test_whole_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {r["doc_id"]: r for r in pieces.encode_pieces(docs, piece_model(), digests=True).collect()}
    texts = docs.select("doc_id", "text").collect()
    assert len(found) == len(texts)
    for doc_id, text in texts:
        ids = library.encode(text)
        row = found[doc_id]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_null_empty_long_repeated_rows_and_clashing_columns(spark, library):
    long = "word " * 50_000 + "x" * 20_000
    rows = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "the", "c"), (3, long, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    found = pieces.encode_pieces(docs, piece_model(), keep=["n_tokens", "text"]).collect()
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert by_id[1][0]["ids"] == [] and by_id[1][0]["decoded"] == ""
    assert len(by_id[2]) == 2 and by_id[2][0]["n_tokens"] == 0
    assert by_id[None][0]["ids"] == library.encode("the")
    assert by_id[3][0]["ids"] == library.encode(long) and by_id[3][0]["decoded"] == long
    assert pieces.encode_pieces(docs.filter(F.lit(False)), piece_model()).count() == 0
