from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelcast.operators import ordered
from tests.helpers import panel

START = dt.datetime(2024, 1, 1)


def event_frame(spark, sizes: dict[str, int], seed: int = 0):
    """Timestamped series; the first holds most rows, bunched into one hour."""
    rng = np.random.default_rng(seed)
    rows = []
    for j, (name, n) in enumerate(sizes.items()):
        span = 3600 if j == 0 else 86400 * 30
        at = np.sort(rng.choice(span * 1000, size=n, replace=False))
        for i, ms in enumerate(at):
            value = None if rng.random() < 0.05 else float(rng.normal())
            rows.append((name, START + dt.timedelta(milliseconds=int(ms)), i, value))
    rng.shuffle(rows)
    rows = [(n, t, int(i), v) for n, t, i, v in rows]
    schema = "series_id string, ds timestamp_ntz, row_no int, y double"
    return spark.createDataFrame(rows, schema), pd.DataFrame(
        rows, columns=["series_id", "ds", "row_no", "y"]
    ).astype({"y": float})


SIZES = {"hot": 400, "b": 37, "c": 3, "d": 1}


@pytest.mark.parametrize("chunk", [None, "hour", "sparse"])
def test_chunked_windows_match_whole_series(spark, chunk):
    df, pdf = event_frame(spark, SIZES)
    column = {
        None: None,
        "hour": F.date_trunc("hour", F.col("ds").cast("timestamp")),
        # A few rows per chunk, so a trailing frame spans many chunks.
        "sparse": F.floor(F.unix_micros(F.col("ds").cast("timestamp")) / 20_000_000),
    }[chunk]
    out = ordered.rolling_mean(df, "y", 3, name="m", chunk=column)
    out = ordered.difference(out, "y", 2, name="d", chunk=column)
    out = ordered.lag_matrix(out, "y", [1, 7, 24], chunk=column)
    got = out.toPandas().sort_values(["series_id", "row_no"]).reset_index(drop=True)
    want = pdf.sort_values(["series_id", "row_no"]).reset_index(drop=True)
    group = want.groupby("series_id")["y"]
    want["m"] = group.transform(lambda s: s.rolling(3).mean())
    want["d"] = want["y"] - group.shift(2)
    for i in (1, 7, 24):
        want[f"y_lag_{i}"] = group.shift(i)
    assert len(got) == len(want)
    for c in ["m", "d", "y_lag_1", "y_lag_7", "y_lag_24"]:
        np.testing.assert_allclose(got[c].astype(float), want[c], atol=1e-12, equal_nan=True)


def test_chunked_positions_splits_and_folds(spark):
    df, pdf = event_frame(spark, SIZES)
    n = pdf["series_id"].map(SIZES)
    out = ordered.time_split(df, horizon=10)
    out = ordered.series_folds(out, 5).toPandas()
    merged = out.merge(pdf[["series_id", "row_no"]].assign(n=n), on=["series_id", "row_no"])
    last = merged["row_no"] >= merged["n"] - 10
    assert ((merged["split"] == "test") == last).all()
    for name, size in SIZES.items():
        folds = merged[merged["series_id"] == name].sort_values("row_no")["fold"].tolist()
        want = [i + 1 for i, part in enumerate(np.array_split(np.arange(size), 5)) for _ in part]
        assert folds == want


def test_no_task_holds_a_whole_hot_series(spark):
    df, _ = event_frame(spark, {"hot": 2000, "b": 10})
    chunked = ordered.even_chunks(df, "ds", 8)
    sizes = chunked.groupBy("series_id", "__chunk").count().toPandas()
    assert sizes["count"].max() <= 2000 / 8 * 1.2 and sizes["count"].sum() == 2010


def test_chunks_from_a_sample_stay_even(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SAMPLE_PER_CHUNK", 40)
    df, pdf = event_frame(spark, {"hot": 3000, "b": 10})
    sizes = ordered.even_chunks(df, "ds", 6).groupBy("__chunk").count().toPandas()
    assert len(sizes) == 6 and sizes["count"].max() < 2 * 3010 / 6
    got = ordered.difference(df, "y", name="d").toPandas()
    want = pdf.sort_values(["series_id", "row_no"])
    want["d"] = want["y"] - want.groupby("series_id")["y"].shift(1)
    got = got.sort_values(["series_id", "row_no"])
    np.testing.assert_allclose(got["d"].astype(float), want["d"], atol=1e-12, equal_nan=True)


def test_chunks_come_from_literals_and_survive_recomputation(spark):
    df, _ = event_frame(spark, SIZES)
    a = ordered.even_chunks(df.repartition(7), "ds", 6).select("row_no", "ds", "__chunk")
    b = ordered.even_chunks(df.coalesce(1), "ds", 6).select("row_no", "ds", "__chunk")
    assert a.exceptAll(b).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    values=st.lists(st.one_of(st.none(), st.floats(-1e3, 1e3)), min_size=1, max_size=40),
    n=st.integers(1, 5),
    parts=st.integers(1, 5),
)
def test_rolling_mean_ignores_layout(spark, values, n, parts):
    rows = [("s", START + dt.timedelta(minutes=i), v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "series_id string, ds timestamp_ntz, y double")
    want = pd.Series(values, dtype=float).rolling(n).mean()
    got = ordered.rolling_mean(df.repartition(parts), "y", n, name="m").orderBy("ds").toPandas()
    np.testing.assert_allclose(got["m"].astype(float), want, atol=1e-6, equal_nan=True)


def test_date_panels_use_one_plain_window(spark):
    df = panel(spark, {"a": np.arange(5.0), "b": np.arange(3.0)})
    plan = ordered.rolling_mean(df, "y", 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("n,k", [(10, 3), (48, 10), (7, 7), (5, 10)])
def test_folds_are_contiguous_with_sizes_of_unshuffled_kfold(spark, n, k):
    df = panel(spark, {"a": np.arange(float(n)), "b": np.arange(float(n))})
    got = ordered.time_folds(df, k).orderBy("series_id", "ds").toPandas()
    want = [i + 1 for i, part in enumerate(np.array_split(np.arange(n), k)) for _ in part]
    assert got["fold"].tolist() == want + want


@pytest.mark.parametrize("n", [1, 9, 100, 333])
def test_random_split_has_exact_size_and_ignores_layout(spark, n):
    df = spark.range(n).withColumn("g", F.lit("x"))
    one = ordered.random_split(df.repartition(3), ["id"], 0.2, 5)
    two = ordered.random_split(df.coalesce(1), ["id"], 0.2, 5)
    assert one.filter("split = 'test'").count() == math.ceil(0.2 * n)
    assert one.exceptAll(two).count() == 0
    assert one.count() == n
    grouped = ordered.random_split(
        df.withColumn("g", F.when(F.col("id") % 3 == 0, "a").otherwise("b")), ["id"], 0.25, 5, ["g"]
    )
    for row in grouped.groupBy("g").agg(
        F.count("*").alias("n"), F.sum((F.col("split") == "test").cast("int")).alias("t")
    ).collect():
        assert row["t"] == math.ceil(0.25 * row["n"])


def test_three_way_split_and_train_rows(spark):
    df = panel(spark, {"a": np.arange(10.0), "b": np.arange(4.0)})
    parts = ordered.three_way_split(df, 2, 3).groupBy("series_id", "split").count().toPandas()
    found = {(r.series_id, r.split): r["count"] for _, r in parts.iterrows()}
    assert found == {
        ("a", "train"): 5,
        ("a", "validate"): 2,
        ("a", "test"): 3,
        ("b", "validate"): 1,
        ("b", "test"): 3,
    }
    with pytest.raises(ValueError):
        ordered.time_split(df, n_train=3, horizon=2)
