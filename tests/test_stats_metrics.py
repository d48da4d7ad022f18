from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import grid, metrics, stats
from tests.helpers import rows_of


@pytest.fixture
def small(spark):
    return spark.createDataFrame(
        [
            (1, "a", 1.0, 5.0, 10.0),
            (2, "a", 3.0, 5.0, float("nan")),
            (3, "b", None, 5.0, 30.0),
            (4, "b", 2.0, 5.0, 20.0),
        ],
        "id int, g string, x double, flat double, y double",
    )


def test_minmax_scale_constant_and_missing(small):
    got = stats.minmax_scale(small, ["x", "flat"]).orderBy("id").toPandas()
    np.testing.assert_allclose(got["x"], [0.0, 1.0, np.nan, 0.5], equal_nan=True)
    assert got["flat"].tolist() == [0.0] * 4


def test_minmax_statistics_from_training_rows_and_groups(small):
    train = small.filter("id <= 2")
    got = stats.minmax_scale(small, ["x"], fit_on=train).orderBy("id").toPandas()
    np.testing.assert_allclose(got["x"], [0.0, 1.0, np.nan, 0.5], equal_nan=True)
    by = stats.minmax_scale(small, ["x"], ["g"]).orderBy("id").toPandas()
    np.testing.assert_allclose(by["x"], [0.0, 1.0, np.nan, 0.0], equal_nan=True)


def test_standardize_uses_population_deviation(small):
    got = stats.standardize(small, ["x", "flat"]).orderBy("id").toPandas()
    x = np.array([1.0, 3.0, np.nan, 2.0])
    np.testing.assert_allclose(got["x"], (x - 2) / np.nanstd(x), equal_nan=True)
    assert got["flat"].tolist() == [0.0] * 4


def test_filling(small):
    got = stats.fill_with_mean_of(small, ["x", "y"], "y").orderBy("id").toPandas()
    assert got["x"].tolist() == [1.0, 3.0, 20.0, 2.0]
    assert got["y"].tolist() == [10.0, 20.0, 30.0, 20.0]
    own = stats.fill_own_mean(small, ["x"], ["g"], flag=True).orderBy("id").toPandas()
    assert own["x"].tolist() == [1.0, 3.0, 2.0, 2.0]
    assert own["x_missing"].tolist() == [0.0, 0.0, 1.0, 0.0]


def test_column_stats(small):
    assert rows_of(stats.column_stats(small, ["x", "flat"]), "feature") == [
        ("flat", 5.0, 5.0),
        ("x", 1.0, 3.0),
    ]


def test_correlated_columns_sign_and_wide_path(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    frame = {"a": x, "b": -x + rng.normal(0, 0.01, 200), "c": x + rng.normal(0, 0.01, 200)}
    for i in range(45):
        frame[f"n{i:02}"] = rng.normal(size=200)
    names = list(frame)
    df = spark.createDataFrame(
        [tuple(float(frame[c][i]) for c in names) for i in range(200)],
        ", ".join(f"{c} double" for c in names),
    )
    narrow = stats.correlated_columns(df, names[:10], 0.8)
    assert rows_of(narrow, "column") == [("c",)]
    assert rows_of(stats.correlated_columns(df, names, 0.8), "column") == [("c",)]
    both = stats.correlated_columns(df, names[:10], 0.8, absolute=True)
    assert rows_of(both, "column") == [("b",), ("c",)]


def test_metrics_by_hand(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 2.0), ("a", 3.0, 3.0), ("b", 0.0, 1.0), ("b", 2.0, None)],
        "g string, y double, yhat double",
    )
    row = metrics.metrics(df.filter("g = 'a'")).first()
    assert (row["n"], row["mae"], row["mse"]) == (2, 0.5, 0.5)
    assert row["r2"] == pytest.approx(0.5)
    assert row["mape"] == pytest.approx(0.5)
    zero = metrics.metrics(df, by=["g"]).filter("g = 'b'").first()
    assert zero["r2"] is None
    assert zero["mape"] == pytest.approx(1 / metrics.EPSILON)


def test_swapped_arguments_change_r2(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 1.5), (3.0, 3.5)], "y double, yhat double")
    right = metrics.metrics(df).first()["r2"]
    swapped = metrics.metrics(df, "yhat", "y").first()["r2"]
    y, p = np.array([1.0, 2, 3]), np.array([1.5, 1.5, 3.5])
    assert right == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert swapped == pytest.approx(1 - ((y - p) ** 2).sum() / ((p - p.mean()) ** 2).sum())


def test_best_trial_ties_and_modes(spark):
    df = spark.createDataFrame(
        [("a", 1, 0.5), ("a", 2, 0.5), ("a", 3, 0.9), ("b", 1, None), ("b", 2, 0.1)],
        "s string, trial_id int, score double",
    )
    assert rows_of(metrics.best_trial(df, "score", "min", ["s"]), "s") == [
        ("a", 1, 0.5),
        ("b", 2, 0.1),
    ]
    assert metrics.best_trial(df, "score", "max").first()["trial_id"] == 3


def test_param_grid_numbers_match_grid_points(spark):
    lists = {"b": [10, 20], "a": ["x", "y", "z"]}
    series = spark.createDataFrame([("s1",), ("s2",)], "series_id string")
    got = grid.param_grid(series, lists).orderBy("series_id", "trial_id").collect()
    want = grid.grid_points(lists)
    assert len(got) == 12
    for s in range(2):
        for i, point in enumerate(want):
            row = got[s * 6 + i]
            assert (row["trial_id"], row["a"], row["b"]) == (i + 1, point["a"], point["b"])


def test_param_grid_has_no_join(spark):
    series = spark.range(3).select(F.col("id").cast("string").alias("series_id"))
    plan = grid.param_grid(series, {"a": [1, 2]})._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_trial_log(spark):
    df = spark.createDataFrame([("s", 1, 3, 0.5)], "series_id string, trial_id int, k int, r2 double")
    row = grid.trial_log(df, ["k"], "r2").first()
    assert row["params"] == {"k": "3"} and row["metric"] == 0.5


def test_cv_mean_score_is_mean_of_folds(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4), (2, 0.9)], "trial_id int, r2 double")
    got = metrics.cv_mean_score(df)
    assert [(i, pytest.approx(v)) for i, v in rows_of(got, "trial_id")] == [(1, 0.3), (2, 0.9)]
