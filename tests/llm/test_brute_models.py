"""Posteriors and language decoding in plain Python from the same evidence and the same weights."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from panelcast.llm import language, quality_prior


def logit(p):
    p = min(max(p, quality_prior.FLOOR), 1 - quality_prior.FLOOR)
    return math.log(p / (1 - p))


def weight(groups, centre):
    """Prior weight from (n, k) per group by one-way analysis of variance."""
    if len(groups) < 2:
        return quality_prior.MOST
    total = sum(n for n, _ in groups)
    between = sum(n * (k / n - c) ** 2 for (n, k), c in zip(groups, centre)) / (len(groups) - 1)
    within = sum(n * (k / n) * (1 - k / n) for n, k in groups) / max(total - len(groups), 1.0)
    size = (total - sum(n * n for n, _ in groups) / total) / (len(groups) - 1)
    found = size * within / max(between - within, 1e-12)
    return min(max(found, quality_prior.LEAST), quality_prior.MOST)


def test_posteriors_equal_plain_formulas(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).withColumn("source", F.when(F.col("doc_id") % 17 > 0, F.col("source")))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    host, path = F.col("source"), F.concat_ws("/", "source", "lang")
    found = quality_prior.quality_posteriors(docs, labels, host, path).collect()
    group = {r["doc_id"]: (r["h"], r["p"]) for r in docs.select("doc_id", host.alias("h"), path.alias("p")).collect()}
    given: dict[int, list[float]] = {}
    for r in labels.filter("quality in (0, 1) and doc_id is not null").collect():
        given.setdefault(r["doc_id"], []).append(r["quality"])
    rows = []
    for r in found:
        label = given.get(r["doc_id"])
        n = 1.0 if label else quality_prior.SOFT
        rows.append((r, n, n * (sum(label) / len(label) if label else r["evidence"])))
    paths, hosts = {}, {}
    for r, n, k in rows:
        h, p = group[r["doc_id"]]
        for table, name in ((paths, (h, p)), (hosts, h)):
            a, b = table.get(name, (0.0, 0.0))
            table[name] = (a + n, b + k)
    centre = sum(k for _, k in hosts.values()) / sum(n for n, _ in hosts.values())
    host_weight = weight(list(hosts.values()), [centre] * len(hosts))
    mean = {h: (k + host_weight * centre) / (n + host_weight) for h, (n, k) in hosts.items()}
    path_weight = weight(list(paths.values()), [mean[h] for h, _ in paths])
    for r, n, k in rows:
        h, p = group[r["doc_id"]]
        hn, hk = hosts[h]
        pn, pk = paths[h, p]
        own_host = (max(hk - k, 0) + host_weight * centre) / (max(hn - n, 0) + host_weight)
        own_path = (max(pk - k, 0) + path_weight * own_host) / (max(pn - n, 0) + path_weight)
        score = 1 / (1 + math.exp(-(logit(r["evidence"]) + logit(own_path) - logit(centre))))
        np.testing.assert_allclose([r["host_posterior"], r["path_posterior"]], [own_host, own_path], rtol=1e-9)
        np.testing.assert_allclose(r["score"], score, rtol=1e-6)
        assert r["kept"] == (r["score"] >= quality_prior.KEEP_FROM)


def test_languages_equal_plain_decoding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    more = [(9001, None, "en"), (9002, "123 456", None), (9003, "", None), (9004, "ab " * 30_000, None)]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    model = language.fit_languages(docs, F.lit(True))
    found = {r["doc_id"]: r for r in language.predict_languages(docs, model).collect()}
    for doc_id, text, _ in docs.collect():
        row = found[doc_id]
        if not any(c.isalpha() for c in text or ""):
            assert (row["lang_pred"], row["score"], row["ambiguous"]) == ("und", 0.0, True)
            continue
        x = language._features(pa.array([text]))[0].astype(float)
        margin = [min(max(float(x @ model.weights[:, b] + model.offsets[b]), -20), 20) for b in range(model.codes.shape[1])]
        losses = [
            sum(w * math.log1p(math.exp(-m * c)) for w, m, c in zip(model.bit_weights, margin, code)) for code in model.codes
        ]
        ranked = sorted(losses)
        best = losses.index(ranked[0])
        total = sum(math.exp(-model.sharpness * (v - ranked[0])) for v in losses)
        np.testing.assert_allclose(row["score"], 1 / total, rtol=1e-4)
        if ranked[1] - ranked[0] > 1e-5:
            assert row["lang_pred"] == model.languages[best]
