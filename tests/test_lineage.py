from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import lineage, stats
from tests.helpers import panel


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_checkpoints_go_to_the_configured_folder(spark):
    folder = lineage.ensure_checkpoint_dir(spark)
    assert spark.conf.get("spark.checkpoint.dir") in folder
    df = lineage.cut(spark.range(3))
    assert "ExistingRDD" in plan(df) and df.count() == 3


@pytest.mark.parametrize("text,size", [("10485760b", 10485760), ("10MB", 10485760), ("-1", 0)])
def test_broadcast_limit_reads_the_session(spark, text, size):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", text)
    try:
        assert lineage.broadcast_limit(spark) == size
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_facts_are_broadcast_only_within_the_limit(spark):
    df = panel(spark, {"a": np.arange(5.0), "b": np.arange(3.0)})
    small = stats.minmax_scale(df, ["y"], ["series_id"])
    assert "BroadcastHashJoin" in plan(small)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        large = stats.minmax_scale(df, ["y"], ["series_id"])
        text = plan(large)
        assert "SortMergeJoin" in text and "hashpartitioning(series_id" in text
        assert "__salt" in text
        assert large.exceptAll(small).count() == 0 and large.count() == 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_group_is_reduced_before_the_shuffle(spark):
    df = spark.range(0, 9000, numPartitions=3).select(
        F.when(F.col("id") % 3 != 0, "hot").otherwise(F.col("id").cast("string")).alias("g"),
        F.col("id").cast("double").alias("x"),
    )
    hot = stats.column_stats(df, ["x"], ["g"]).filter("g = 'hot'").first()
    assert (hot["min_value"], hot["max_value"]) == (1.0, 8999.0)
    text = plan(df.groupBy("g").agg(F.min("x")))
    assert "partial_min" in text
