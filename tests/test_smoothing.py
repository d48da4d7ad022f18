from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import smoothing
from panelcast.operators.smoothing import Weights
from tests.helpers import months, panel, seasonal_series


def reference(y, a, b, g, m, trend=True):
    """The recursion row by row; (sse, fitted, level, trend, season phases with the next first)."""
    y = np.asarray(y)[~np.isnan(y)]
    level = y[:m].mean()
    slope = (y[m : 2 * m].mean() - level) / m if trend else 0.0
    season = list(y[:m] - level)
    sse, fitted = 0.0, []
    for v in y:
        f = level + slope + season[0]
        before = level
        level = a * (v - season[0]) + (1 - a) * (level + slope)
        new = g * (v - before - slope) + (1 - g) * season[0]
        slope = b * (level - before) + (1 - b) * slope if trend else 0.0
        season = [*season[1:], new]
        sse += (v - f) ** 2
        fitted.append(f)
    return sse, np.array(fitted), level, slope, season


def series():
    made = {"a": seasonal_series(60, 1), "b": seasonal_series(47, 2, 1.0), "c": seasonal_series(24, 3)}
    made["b"][[5, 30]] = np.nan
    return made


@pytest.mark.parametrize("chunk_rows", [1 << 14, 24, 13, 5, 1])
def test_search_equals_the_plain_recursion(spark, chunk_rows):
    data = series() | {"short": seasonal_series(23, 4)}
    weights = Weights(alpha=(0.2, 0.6), beta=(0.1, 0.4), gamma=(0.1, 0.5))
    frame = panel(spark, data)
    log = smoothing.smoothing_trials(frame, weights, chunk_rows=chunk_rows).toPandas()
    assert set(log["series_id"]) == {"a", "b", "c"} and len(log) == 3 * 8
    for r in log.itertuples():
        want = reference(data[r.series_id], r.alpha, r.beta, r.gamma, 12)[0]
        np.testing.assert_allclose(r.sse, want, rtol=1e-9)
    model = smoothing.fit_smoothing(frame, weights, chunk_rows=chunk_rows)
    fits = {r["series_id"]: r for r in model.collect()}
    assert fits["short"]["reason"] == "too short" and fits["short"]["alpha"] is None
    rows = smoothing.smoothed_rows(model, frame, chunk_rows=chunk_rows).toPandas().sort_values(["series_id", "ds"])
    for name in "abc":
        own = log[log["series_id"] == name]
        best = own.sort_values(["sse", "trial_id"]).iloc[0]
        fit = fits[name]
        assert fit["trial_id"] == best["trial_id"]
        sse, fitted, level, slope, season = reference(data[name], fit["alpha"], fit["beta"], fit["gamma"], 12)
        np.testing.assert_allclose(fit["sse"], sse, rtol=1e-9)
        np.testing.assert_allclose(fit["last_state"], [level, slope, *season], atol=1e-9)
        np.testing.assert_allclose(rows[rows["series_id"] == name]["fitted"], fitted, atol=1e-9)


@pytest.mark.parametrize("m, trend", [(1, True), (1, False), (4, False)])
@pytest.mark.parametrize("chunk_rows", [100, 3])
def test_without_season_or_trend(spark, m, trend, chunk_rows):
    data = {"a": seasonal_series(30, 5), "one": np.array([3.0])}
    weights = Weights(alpha=(0.3,), beta=(0.2,), gamma=(0.4,), m=m, trend=trend)
    fits = smoothing.fit_smoothing(panel(spark, data), weights, chunk_rows=chunk_rows)
    found = {r["series_id"]: r for r in fits.collect()}
    y = data["a"]
    level, slope = (y[0], (y[1] - y[0]) if trend else 0.0) if m == 1 else (y[:4].mean(), 0.0)
    season = [0.0] if m == 1 else list(y[:4] - level)
    for v in y:
        e = v - level - slope - season[0]
        level, slope = level + slope + 0.3 * e, slope + (0.06 * e if trend else 0.0)
        season = [*season[1:], season[0] + (0.4 * e if m > 1 else 0.0)]
    np.testing.assert_allclose(found["a"]["last_state"], [level, slope, *season], atol=1e-9)
    assert (found["one"]["reason"] is None) == (m == 1 and not trend)


def test_forecast_and_interval(spark):
    data = series()
    frame = panel(spark, data)
    model = smoothing.fit_smoothing(frame, Weights(alpha=(0.3,), beta=(0.1,), gamma=(0.2,)))
    ahead = months(85)[60:]
    future = spark.createDataFrame([(s, d) for s in ("a", "zz") for d in ahead], "series_id string, ds date")
    got = smoothing.forecast_smoothing(model, future).toPandas().sort_values(["series_id", "ds"])
    own = got[got["series_id"] == "a"].reset_index(drop=True)
    sse, _, level, slope, season = reference(data["a"], 0.3, 0.1, 0.2, 12)
    want = [level + (h + 1) * slope + season[h % 12] for h in range(25)]
    np.testing.assert_allclose(own["yhat"], want, atol=1e-9)
    for h in (1, 2, 13, 25):
        c = [0.3 + 0.03 * j + (0.2 if j % 12 == 0 else 0.0) for j in range(1, h)]
        half = 1.959963984540054 * np.sqrt(sse / 60 * (1 + sum(x * x for x in c)))
        np.testing.assert_allclose(own["yhat_upper"][h - 1] - own["yhat"][h - 1], half, rtol=1e-9)
    missing = got[got["series_id"] == "zz"]
    assert missing["yhat"].isna().all() and set(missing["reason"]) == {"no model"}


def test_multiplicative_mode_is_additive_in_logarithms(spark):
    y = np.exp(seasonal_series(48, 6) / 10)
    frame = panel(spark, {"a": y})
    weights = Weights(alpha=(0.3,), beta=(0.1,), gamma=(0.2,))
    model = smoothing.fit_smoothing(frame, weights, mode="multiplicative")
    rows = smoothing.smoothed_rows(model, frame, mode="multiplicative").toPandas().sort_values("ds")
    np.testing.assert_allclose(np.log(rows["fitted"]), reference(np.log(y), 0.3, 0.1, 0.2, 12)[1], atol=1e-9)
    zero = frame.withColumn("y", F.lit(0.0))
    assert [r["reason"] for r in smoothing.fit_smoothing(zero, weights, mode="multiplicative").collect()] == ["too short"]
    with pytest.raises(ValueError):
        smoothing.fit_smoothing(frame, weights, mode="other")


def test_empty_panel(spark):
    empty = panel(spark, {"a": seasonal_series(30, 1)}).filter(F.lit(False))
    model = smoothing.fit_smoothing(empty)
    assert model.count() == 0 and smoothing.smoothed_rows(model, empty).count() == 0


def test_season_and_weights_are_recovered(spark):
    rng = np.random.default_rng(8)
    season, level, slope, y = list(np.sin(np.arange(12))), 10.0, 0.05, []
    for _ in range(600):
        e = rng.normal(0, 0.5)
        y.append(level + slope + season[0] + e)
        level, slope = level + slope + 0.5 * e, slope + 0.5 * 0.05 * e
        season = [*season[1:], season[0] + 0.05 * e]
    r = smoothing.fit_smoothing(panel(spark, {"a": np.array(y)}), chunk_rows=100).first()
    assert abs(r["alpha"] - 0.5) <= 0.2 and r["beta"] == 0.05 and r["gamma"] < 0.5
    assert 0.4 < np.sqrt(r["sse"] / r["n"]) < 0.6
