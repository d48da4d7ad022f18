"""Bounded samples: what moves, and rows that share a key."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.llm import text


def test_hash_limit_applies_before_rows_move(spark):
    rows = spark.range(20000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 < 2, 1).otherwise(0).alias("y"))
    rows = rows.unionByName(spark.createDataFrame([(None, None), (5, None)], "k bigint, y int"))
    sampled = text.least_hashes(rows, "k", "y", 100, 1)
    plan = sampled._jdf.queryExecution().executedPlan().toString()
    assert plan.index("__rank") < plan.index("Exchange hashpartitioning(y") < plan.index("pmod(xxhash64(")
    found = sampled.collect()
    assert sorted((r["y"], r["__rank"]) for r in found) == [(y, i) for y in (0, 1) for i in range(1, 101)]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert sorted(map(tuple, text.least_hashes(rows, "k", "y", 100, 1).collect())) == sorted(map(tuple, found))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_one_row_per_key_reaches_the_driver(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (2, "c")] + [(3, "x")] * 50, "k bigint, t string")
    chosen = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "k bigint, y int")
    found = text.sample_rows(docs, chosen, "k", ["t"], 10)
    assert sorted((r["k"], r["y"], r["t"]) for r in found) == [(1, 0, "a"), (2, 1, None), (3, 1, "x")]
