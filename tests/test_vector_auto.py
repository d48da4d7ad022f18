from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.operators import vector_auto
from tests.helpers import least_squares

COLS = ["y", "x", "v w"]
A1 = np.array([[0.5, 0.2, 0.0], [-0.3, 0.4, 0.1], [0.0, 0.1, 0.3]])
A2 = np.array([[0.2, 0.0, 0.1], [0.0, -0.2, 0.0], [0.1, 0.0, 0.2]])


def simulate(n, seed, a1=A1, a2=A2):
    rng = np.random.default_rng(seed)
    z = np.zeros((n + 50, 3))
    for t in range(2, n + 50):
        z[t] = [1.0, 20.0, -3.0] + a1 @ z[t - 1] + a2 @ z[t - 2] + rng.normal(0, [1.0, 4.0, 0.2])
    return z[50:]


def frame(spark, data):
    rows = []
    for name, z in data.items():
        days = pd.date_range("2015-01-01", periods=len(z), freq="D").date
        rows += [(name, d, *[None if np.isnan(v) else float(v) for v in row]) for d, row in zip(days, z)]
    return spark.createDataFrame(rows, "series_id string, ds date, y double, x double, `v w` double")


def design(z, lags, skip):
    past = [z[skip - i : len(z) - i] for i in range(1, lags + 1)]
    return np.concatenate([np.ones((len(z) - skip, 1)), *past], axis=1), z[skip:]


@pytest.mark.parametrize("chunk", [None, "month"])
def test_coefficients_equal_least_squares(spark, chunk):
    data = {"a": simulate(120, 1), "b": simulate(70, 2)}
    column = F.trunc("ds", "MM") if chunk else None
    model = vector_auto.fit_var(frame(spark, data), COLS, 2, fixed=True, chunk=column)
    table = vector_auto.var_coefficients(model, COLS).toPandas()
    fits = {r["series_id"]: r for r in model.collect()}
    for name, z in data.items():
        x, targets = design(z, 2, 2)
        for i, c in enumerate(COLS):
            beta, se, _ = least_squares(x, targets[:, i])
            own = table[(table["series_id"] == name) & (table["equation"] == c)].set_index("term")
            terms = ["const", *[f"L{lag}.{other}" for lag in (1, 2) for other in COLS]]
            np.testing.assert_allclose(own.loc[terms, "coefficient"], beta, rtol=1e-6, atol=1e-8)
            np.testing.assert_allclose(own.loc[terms, "std_error"], se, rtol=1e-6)
        rest = targets - x @ np.linalg.lstsq(x, targets, rcond=None)[0]
        np.testing.assert_allclose(
            np.array(fits[name]["sigma"]).reshape(3, 3), rest.T @ rest / (len(x) - 7), rtol=1e-6
        )
        assert fits[name]["stable"] and fits[name]["n"] == len(z) - 2


def test_lags_and_coefficients_are_recovered(spark):
    model = vector_auto.fit_var(frame(spark, {"a": simulate(4000, 3)}), COLS, 4, chunk=F.trunc("ds", "MM"))
    row = model.first()
    assert row["lags"] == 2
    coef = np.array(row["coef"]).reshape(2, 3, 3).transpose(0, 2, 1)
    spread = np.array([1.0, 4.0, 0.2])
    unit = spread[None, :] / spread[:, None]
    assert np.abs((coef[0] - A1) * unit).max() < 0.12 and np.abs((coef[1] - A2) * unit).max() < 0.12
    # the eigenvalue of a direct fit on the same rows
    x, targets = design(simulate(4000, 3), 2, 4)
    x = np.concatenate([x[:, :1], x[:, 1:7]], axis=1)
    beta = np.linalg.lstsq(x, targets, rcond=None)[0]
    top = np.concatenate([beta[1:4].T, beta[4:7].T], axis=1)
    want = np.abs(np.linalg.eigvals(np.concatenate([top, np.eye(3, 6)]))).max()
    assert abs(row["radius"] - want) < 1e-6 and row["stable"]


def test_joint_forecast_equals_a_loop(spark):
    z = simulate(90, 4)
    z[30, 1] = np.nan
    data = {"a": z, "alike": np.repeat(simulate(60, 5)[:, :1], 3, axis=1), "few": simulate(5, 6)}
    rng, wild = np.random.default_rng(7), [np.array([1.0, -2.0, 3.0])]
    for _ in range(60):
        wild.append(wild[-1] * [1.1, 1.06, 1.08] + rng.normal(0, 1, 3))
    data["wild"] = np.array(wild)
    panel = frame(spark, data)
    model = vector_auto.fit_var(panel, COLS, 2, fixed=True)
    ahead = pd.date_range("2030-01-01", periods=500, freq="D").date.tolist()
    future = spark.createDataFrame(
        [(s, d) for s in ("a", "alike", "few", "wild", "unknown") for d in ahead], "series_id string, ds date"
    )
    got = vector_auto.forecast_var(model, panel, future, COLS).toPandas().sort_values(["series_id", "ds"])
    known = z[~np.isnan(z).any(axis=1)]
    x, targets = design(known, 2, 2)
    beta = np.linalg.lstsq(x, targets, rcond=None)[0]
    path = list(known[-2:])
    for _ in ahead:
        path.append(np.concatenate([[1.0], path[-1], path[-2]]) @ beta)
    own = got[got["series_id"] == "a"]
    np.testing.assert_allclose(own[["y_hat", "x_hat", "v w_hat"]], path[2:], rtol=1e-5, atol=1e-6)
    assert own["reason"].isna().all()
    for name, reason in (("alike", "singular"), ("few", "singular"), ("wild", "unstable"), ("unknown", "no model")):
        other = got[got["series_id"] == name]
        assert len(other) == 500 and other["y_hat"].isna().all() and set(other["reason"]) == {reason}


def test_series_side_by_side_and_empty(spark):
    long = spark.createDataFrame(
        [("a", 1, 1.0), ("b", 1, 2.0), ("a", 2, 3.0), ("c", 2, 9.0), ("b", 3, float("nan"))],
        "series_id string, ds int, y double",
    )
    wide = vector_auto.align_series(long, ["a", "b"]).orderBy("ds").collect()
    assert [tuple(r) for r in wide] == [(1, 1.0, 2.0), (2, 3.0, None), (3, None, None)]
    empty = frame(spark, {"a": simulate(9, 1)}).filter(F.lit(False))
    model = vector_auto.fit_var(empty, COLS, 2)
    assert model.count() == 0
    assert vector_auto.forecast_var(model, empty, empty.select("series_id", "ds"), COLS).count() == 0
