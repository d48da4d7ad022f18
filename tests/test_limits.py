"""No hidden limits: wide gapped tables, many features, tied dates, NaN and missing inputs."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from panelcast.operators import attribution, metrics, ordered, sarx, stats, trees
from tests.helpers import months, panel, seasonal_series


def test_correlations_of_a_wide_gapped_table_use_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 45))
    x[:, 40] = x[:, 3] + rng.normal(scale=0.1, size=60)
    x[rng.random(x.shape) < 0.3] = np.nan
    names = [f"c{i}" for i in range(45)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names))
    found = {(r["i"], r["j"]): r["corr"] for r in stats.correlations(df, names).collect()}
    want = pd.DataFrame(x).corr()
    assert len(found) == 45 * 44 // 2
    for (i, j), r in found.items():
        assert r == pytest.approx(want.iloc[i, j], abs=1e-9)
    flagged = {r["column"] for r in stats.correlated_columns(df, names, 0.8).collect()}
    assert flagged == {"c40"}


def test_nan_is_a_missing_value_everywhere(spark):
    rows = [("a", dt.date(2020, 1, d), v) for d, v in enumerate((1.0, 2.0, float("nan"), 3.0), 1)]
    df = spark.createDataFrame(rows, "series_id string, ds date, y double")

    def values(out, c="y"):
        return [r[c] for r in out.orderBy("ds").collect()]

    assert values(stats.minmax_scale(df, ["y"])) == [0.0, 0.5, None, 1.0]
    spread = np.std([1, 2, 3])
    assert values(stats.standardize(df, ["y"])) == pytest.approx([-1 / spread, 0, None, 1 / spread])
    assert values(ordered.rolling_mean(df, "y", 2), "y_mean_2") == [None, 1.5, None, None]
    assert values(ordered.difference(df, "y"), "y_diff_1") == [None, 1.0, None, None]
    (extremes,) = stats.column_stats(df, ["y"]).collect()
    assert (extremes["min_value"], extremes["max_value"]) == (1.0, 3.0)
    (score,) = metrics.metrics(df.withColumn("yhat", F.col("y") + 1)).collect()
    assert (score["n"], score["mae"]) == (3, 1.0)


def test_tied_dates_and_whole_tables_are_cut_into_chunks(spark):
    rows = [("a", dt.date(2020, 1, 1 + i % 3), i, float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "series_id string, ds date, event_id int, y double")
    assert not ordered.calendar_bounded(df, ["series_id"], ["ds", "event_id"])
    assert not ordered.calendar_bounded(df, [], ["ds"])
    assert ordered.calendar_bounded(df, ["series_id"], ["ds"])
    found = ordered.lag_matrix(df, "y", [1], order=["ds", "event_id"])
    assert "__chunk" in found._jdf.queryExecution().toString()
    ranked = sorted(rows, key=lambda r: (r[1], r[2]))
    want = {b[2]: a[3] for a, b in zip(ranked, ranked[1:])}
    assert {r["event_id"]: r["y_lag_1"] for r in found.collect()} == {**want, ranked[0][2]: None}


def test_exact_attribution_of_eleven_features(spark):
    rng = np.random.default_rng(2)
    names = [f"x{i}" for i in range(11)]
    x = rng.normal(size=(12, 11))
    beta = rng.normal(size=11)
    frame = pd.DataFrame(x, columns=names).assign(row_id=[str(i) for i in range(12)], y=x @ beta)
    df = spark.createDataFrame(frame)
    table = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    model = LinearRegression(labelCol="y").fit(table)
    phi = attribution.shapley(model, df.limit(2), df, names, ["row_id"], n_background=12).collect()
    for r in phi:
        i = names.index(r["feature"])
        want = model.coefficients[i] * (r["value"] - x[:, i].mean())
        assert r["phi"] == pytest.approx(want, abs=1e-6)
    with pytest.raises(ValueError):
        attribution.shapley(model, df, df, names, ["row_id"], method="guess")


def test_depth_beyond_the_library_is_refused():
    with pytest.raises(ValueError):
        trees.forest(maxDepth=31)
    with pytest.raises(ValueError):
        trees.gbt(maxDepth=31)


def test_order_bounds_hold_as_given():
    free = sarx.Orders()
    assert (free.p, free.q, free.P, free.Q) == (5, 5, 5, 5)
    assert sarx.Orders(history=48).P == 1


def test_forecast_does_not_invent_values(spark):
    y = {"a": seasonal_series(60, 1), "b": seasonal_series(60, 2), "short": seasonal_series(6, 3)}
    x = {k: np.sin(np.arange(len(v))) for k, v in y.items()}
    y = {k: v + 4 * x[k] for k, v in y.items()}
    orders = sarx.Orders(m=12, max_p=2, max_q=0, max_P=1, max_Q=0, long_ar=4, history=48)
    history = panel(spark, y, x_a=x)
    model = sarx.fit_sarx(history, ["x_a"], orders)
    dates = months(66)[60:]
    rows = [(k, d, None if (k, i) == ("b", 2) else 0.1) for k in y for i, d in enumerate(dates)]
    future = spark.createDataFrame(rows, "series_id string, ds date, x_a double")
    found = sarx.forecast_sarx(model, history, future, ["x_a"], orders).orderBy("ds").collect()
    assert len(found) == len(rows)
    by = {k: [(r["yhat"] is not None, r["reason"]) for r in found if r["series_id"] == k] for k in y}
    assert by["a"] == [(True, None)] * 6
    assert by["b"][:2] == [(True, None)] * 2 and by["b"][2] == (False, "missing input")
    assert by["short"] == [(False, "no model")] * 6


def test_order_search_runs_once_and_sorts_no_data(spark):
    history = panel(spark, {"a": seasonal_series(60, 1)})
    orders = sarx.Orders(m=12, max_p=1, max_q=1, max_P=0, max_Q=0, history=48)
    plan = sarx.fit_sarx(history, [], orders)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "SortAggregate" not in plan
