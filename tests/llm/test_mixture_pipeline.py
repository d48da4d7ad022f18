"""Source mixing by brute-force apportionment, plan rules, and the pipeline stage by stage."""

from __future__ import annotations

import heapq
import os
import re
import subprocess
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelcast.llm import mixture, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / w for s in names}
        over = {s for s in names if target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def brute_quota(target, seats):
    quota = dict.fromkeys(target, 0)
    heap = [(-v, i, s) for i, (s, v) in enumerate(target.items()) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, i, s = heapq.heappop(heap)
        quota[s] += 1
        heapq.heappush(heap, (-target[s] / (2 * quota[s] + 1), i, s))
    return quota


@pytest.mark.parametrize("shard_rows", [16384, 40])
def test_targets_quotas_and_caps(spark, sf, monkeypatch, shard_rows):
    monkeypatch.setattr(mixture, "SHARD_ROWS", shard_rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    more = [(5000 + i, "a b c " * (i % 9), "Ω") for i in range(30)] + [(6000, "x " * 900, None)]
    more += [(6001, None, None), (6002, "", "empty"), (6003, "y z", "tiny"), (6003, "y z", "tiny"), (None, "k", "tiny")]
    docs = docs.union(spark.createDataFrame(more, docs.schema)).withColumn("size", F.lit("clash"))
    rows = [(r["doc_id"], len(WORD.findall(r["text"] or "")), r["source"]) for r in docs.collect()]
    found = mixture.mix_sources(docs, keep=["source", "size"]).collect()
    assert len(found) == len(rows)
    sizes = {}
    for _, n, s in rows:
        sizes[s] = sizes.get(s, 0) + n
    target = brute_targets(sizes)
    quota = brute_quota(target, round(sum(sizes.values()) / mixture.BLOCK))
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    shards = max(1, -(-len(rows) // shard_rows))
    for s, n in taken.items():
        assert abs(n - quota[s] * mixture.BLOCK) <= mixture.BLOCK * shards
    again = mixture.mix_sources(docs.repartition(3)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, again)) == sorted(map(key, found))


def test_mixture_runs_without_python(spark, sf):
    plan = mixture.mix_sources(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


def test_mixture_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixture.mix_sources(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], empty.schema)
    assert [r["taken"] for r in mixture.mix_sources(blank).collect()] == [0, 0]


def test_mixed_rows_hold_what_was_taken(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taken = {r["doc_id"]: r["taken"] for r in mixture.mix_sources(docs).collect()}
    words = {}
    for r in mixture.apply_mix(docs, corpus_pipeline.COLUMNS).collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert words == {d: n for d, n in taken.items() if n}


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(7000, None, "en", "src1", None), (7001, "", None, None, 0), (None, docs.first()["text"], "en", "src1", 1)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, sf).cache()
        counts[name] = docs.count()
        if name != "sentencepiece":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "simhash_near_dedup":
            groups = queries.simhash.near_duplicates(before.filter("doc_id is not null"))
            assert docs.filter("doc_id is not null").count() == groups.select("class_id").distinct().count()
        if name == "secret_scans":
            assert docs.filter(F.col("text").rlike("token = \"[0-9a-f]{20}")).count() == 0
            assert docs.count() == before.count()
    assert 0 < counts["simhash_near_dedup"] < counts["quality_rules"] < 203


def test_rows_of_one_id_with_different_texts_are_told_apart(spark):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    near = texts[1].upper()
    rows = [(5, texts[0]), (5, texts[1]), (5, texts[1]), (5, None), (6, near), (7, texts[2]), (3, texts[2])]
    rows = [(d, t, "en", "s", len(t or "")) for d, t in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted(
        [(5, texts[0]), (5, texts[1]), (5, None), (3, texts[2])], key=str
    )


def test_queries_return_the_columns_asked_for(spark, sf):
    wanted = {
        "op1": "doc_id held_out score predicted",
        "op2": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op3": "doc_id n_words n_removed kept_sha256",
        "op4": "doc_id fingerprint component_id",
        "op6": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op7": "vec_id n_links component_id kept",
        "op8": "doc_id size source_size target taken",
        "op9": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op10": "doc_id held_out lang_pred score",
        "op11": "doc_id n_bytes n_removed n_spans kept_sha256",
        "op12": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
        "op13": "lang source part item value rank",
    }
    for name, make in queries.REGISTRY.items():
        op = name.split("_")[0]
        if op in wanted:
            assert set(wanted[op].split()) <= set(make(spark, sf).columns)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, sf, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = db.sql(queries.ORACLES[name]).df()
    order = ["doc_id"] if "doc_id" in want else [c for c in want if want[c].dtype == object]
    want = want.sort_values(order).reset_index(drop=True)
    got = queries.REGISTRY[name](spark, sf).toPandas().sort_values(order).reset_index(drop=True)
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        same = np.isclose(got[c], want[c]) if c == "target" else got[c] == want[c]
        assert same.all(), c


def test_entry_works_without_the_text_operators(tmp_path):
    """The entry module imports where subpackage and pipeline are absent."""
    (tmp_path / "panelcast").mkdir()
    for name in os.listdir(f"{ROOT}/panelcast"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{ROOT}/panelcast/{name}", tmp_path / "panelcast" / name)
    source = open(f"{ROOT}/__spark_entry__.py").read()
    (tmp_path / "__spark_entry__.py").write_text(source)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 74 and 'pipeline' not in q; e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env, timeout=120)


def test_brute_force_agrees_on_ties():
    assert brute_quota({"a": 1.0, "b": 1.0}, 3) == {"a": 2, "b": 1}
    assert np.isclose(sum(brute_targets({"a": 5, None: 7}).values()), 12)


def test_pipeline_stages_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
