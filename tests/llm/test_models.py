"""Toxicity, quality and language models: exact counts by brute force, held-out accuracy, edge cases."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelcast.llm import language, linear, quality_prior, quality_rules, text, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def syllables(rng, n, parts):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    """Documents in three made-up languages; some hold a toxic root, some are symbol junk."""
    rng = random.Random(0)
    tongues = {"aa": ["ka", "lo", "mi", "su"], "bb": ["tch", "ürg", "ach", "pf"], "cc": ["ión", "eño", "ra", "que"]}
    docs, labels = [], []
    for i in range(900):
        lang = ("aa", "bb", "cc")[i % 3]
        words = syllables(rng, rng.randint(30, 120), tongues[lang]).split()
        toxic, junk = i % 5 == 0, i % 7 == 0
        if junk:
            words = [w + "&&$#" for w in words]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "zorgnak" + rng.choice(["", "li", "mo", "."]))
        docs.append((i, " ".join(words), lang if i % 11 else None, f"s{i % 4}"))
        labels.append((i, 0 if junk else 1, int(toxic)))
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string"),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    )


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "1234 ?!"), (5, "x" * 300_000), (6, "lo " * 60_000), (6, "lo"), (None, "ka")]


@pytest.fixture(scope="module")
def odd(spark):
    frame = spark.createDataFrame(ODD, "doc_id bigint, text string")
    return frame.withColumns({"score": F.lit("clash"), "quality": F.lit("clash"), "lang": F.lit(None)})


def test_gradients_of_the_network_match_differences():
    laid = toxicity.lay(pa.array(["ka lo mi zorgnak su", "mi " * 20, "lo su ka " * 9]))
    p = {k: v.astype(np.float64) for k, v in toxicity.start().items()}
    p["words"] = np.random.default_rng(1).normal(0, 0.1, (1 << toxicity.WORD_BITS, toxicity.WORD_DIM))
    windows = np.flatnonzero(laid.window_rows >= 0)
    laid = toxicity._picked(laid, windows)
    y = np.arange(len(windows)) % 2

    def loss():
        own = toxicity.logits(laid, p)[::2]
        return np.sum(np.logaddexp(0, own) - y * own)

    grads = toxicity.gradients(laid, y, np.ones(len(y)), p)
    used = laid.slots[0]
    places = [("in", (3, 7)), ("bias", (30,)), ("again", (1, 2, 5)), ("view", (2, 3)), ("look", (1,))]
    places += [("out", (4,)), ("level", (0,)), ("words", (used, 1)), ("chars", (laid.gram_slot[0], 2))]
    for name, at in places:
        for step in (3e-2,):
            before = p[name][at]
            p[name][at] = before + step
            up = loss()
            p[name][at] = before - step
            down = loss()
            p[name][at] = before
            assert grads[name][at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=3e-3)


def test_windows_cover_every_word_and_overlap():
    laid = toxicity.lay(pa.array([" ".join(f"w{i}" for i in range(61)), None, "a"]))
    rows = laid.window_rows
    for row, words in ((0, 61), (1, 0), (2, 1)):
        held = np.concatenate([laid.places[w : w + 2].ravel() for w in np.flatnonzero(rows == row)])
        assert len(np.unique(held[held >= 0])) == words


def test_toxicity_on_held_out_documents(labelled, odd):
    docs, labels = labelled
    apart = text.learned_fold(F.col("doc_id"), 3, 1)
    model = toxicity.fit_toxicity(docs, labels, ~apart)
    rows = toxicity.score_toxicity(docs, model).join(labels, "doc_id").filter(apart).collect()
    assert {r["doc_id"] for r in rows} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1}
    predicted, truth = np.array([(r["predicted"], r["toxic"]) for r in rows]).T
    assert predicted[truth == 1].mean() > 0.9 and predicted[truth == 0].mean() < 0.03
    found = toxicity.score_toxicity(odd, model, keep=["score"]).collect()
    assert len(found) == len(ODD) and all(0 <= r["score"] <= 1 for r in found)
    empty = [r["score"] for r in found if r["doc_id"] in (1, 2, 3)]
    assert len(set(empty)) == 1
    assert toxicity.score_toxicity(odd.filter(F.lit(False)), model).count() == 0
    none = toxicity.fit_toxicity(docs, labels.filter(F.lit(False)), ~apart)
    assert {r["score"] for r in toxicity.score_toxicity(odd, none).collect()} == {0.0}


def brute_counts(t):
    t = t or ""
    words = WORD.findall(t)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    symbols = sum(t.count(c) for c in "#*$%&|<>")
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(covered), failed


def test_quality_counts_and_verdict(spark, labelled, odd):
    docs, labels = labelled
    model = quality_rules.fit_quality(docs, labels)
    rng = random.Random(4)
    extra = [
        (1000 + i, rng.choice(["", "a b\n", "é|x "]).join(rng.choice(["a", "b\n", "c ", "  ", "<q>"]) for _ in range(n)))
        for i, n in enumerate((5, 60, 200, 400, 800))
    ]
    own = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id bigint, text string"))
    rows = quality_rules.quality_rules(own.union(odd.select("doc_id", "text")), model, keep=["text"]).collect()
    for r in rows:
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert got == brute_counts(r["text"])
        assert r["kept"] == (not r["base_failed"] and r["quality"] >= quality_rules.KEEP_FROM)
    good = {r["doc_id"]: r["quality"] for r in labels.collect()}
    verdict = np.array([(r["kept"], good[r["doc_id"]]) for r in rows if r["doc_id"] in good and not r["base_failed"] and r["doc_id"] > 6])
    assert verdict[verdict[:, 1] == 1, 0].mean() > 0.98 and verdict[verdict[:, 1] == 0, 0].mean() < 0.05
    assert quality_rules.quality_rules(odd.filter(F.lit(False)), model).count() == 0
    assert quality_rules.fit_quality(docs, labels.filter(F.lit(False))).words is None


def test_calibrated_probabilities_follow_shares():
    rng = np.random.default_rng(5)
    margin = rng.normal(0, 3, 4000)
    y = (rng.random(4000) < linear.sigmoid(0.5 * margin - 1)).astype(float)
    slope, offset = linear.calibrate(margin, y)
    assert slope == pytest.approx(0.5, abs=0.08) and offset == pytest.approx(-1, abs=0.15)


def test_language_on_held_out_documents(labelled, odd):
    docs, _ = labelled
    apart = text.learned_fold(F.col("doc_id"), 4, 2)
    model = language.fit_languages(docs, ~apart)
    rows = language.predict_languages(docs, model, keep=["lang"]).filter(apart & F.col("lang").isNotNull()).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.99
    found = language.predict_languages(odd, model, keep=["score", "lang"]).collect()
    assert len(found) == len(ODD) and all(0 <= r["score"] <= 1 for r in found)
    assert {r["doc_id"]: r["lang_pred"] for r in found if r["doc_id"] in (1, 2, 3, 4)} == dict.fromkeys((1, 2, 3, 4), "und")
    assert all(r["lang_pred"] in ("aa", "bb", "cc") for r in found if r["doc_id"] in (5, 6, None))
    assert language.predict_languages(odd.filter(F.lit(False)), model).count() == 0
    nothing = language.fit_languages(docs.filter(F.lit(False)), ~apart)
    assert {r["lang_pred"] for r in language.predict_languages(odd, nothing).collect()} == {"und"}


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 9, 20):
        code = language.codewords(n)
        assert len(np.unique(code, axis=0)) == n
        assert (np.abs(code.sum(axis=0)) < n).all()


def test_hierarchical_posteriors_shrink_sparse_sites(spark, labelled):
    docs, labels = labelled
    bad = docs.select("doc_id", "text", F.when(F.col("doc_id") < 300, "bad").otherwise("good").alias("host"))
    site = labels.withColumn("quality", (F.col("doc_id") >= 300).cast("int"))
    extra = spark.createDataFrame([(9001, None, "rare"), (9002, "ka lo", None), (9002, "ka lo", None)], "doc_id bigint, text string, host string")
    found = quality_prior.quality_posteriors(bad.union(extra), site, F.col("host"), F.lit("p")).collect()
    by_id = {r["doc_id"]: r for r in found}
    assert len(found) == 903
    assert by_id[5]["host_posterior"] < 0.3 < 0.8 < by_id[700]["host_posterior"]
    assert 0.3 < by_id[9001]["host_posterior"] < 0.8  # no counts of its own: near the global share
    assert by_id[5]["score"] < by_id[5]["evidence"] + 1e-9
    assert all(0 <= r["score"] <= 1 for r in found)
    assert quality_prior.quality_posteriors(bad.filter(F.lit(False)), site, F.col("host"), F.lit("p")).count() == 0
