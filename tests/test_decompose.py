from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.operators import decompose, ordered
from tests.helpers import panel, seasonal_series

START = dt.datetime(2024, 1, 1)


def reference(y: np.ndarray, m: int, mode: str):
    """Trend by an explicit filter, phase means, rest."""
    weights = np.ones(m) / m if m % 2 else np.concatenate([[0.5], np.ones(m - 1), [0.5]]) / m
    half, trend = m // 2, np.full(len(y), np.nan)
    for i in range(half, len(y) - half):
        trend[i] = y[i - half : i + half + 1] @ weights
    left = y - trend if mode == "additive" else y / trend
    means = np.array([np.nanmean(left[p::m]) if np.isfinite(left[p::m]).any() else np.nan for p in range(m)])
    centre = np.nanmean(means) if np.isfinite(means).any() else np.nan
    means = means - centre if mode == "additive" else means / centre
    season = means[np.arange(len(y)) % m]
    return trend, season, left - season if mode == "additive" else left / season


@pytest.mark.filterwarnings("ignore:Mean of empty slice")
@pytest.mark.parametrize("mode", decompose.MODES)
@pytest.mark.parametrize("m", [12, 7, 2])
def test_parts_equal_an_explicit_filter(spark, m, mode):
    series = {"a": seasonal_series(60, 1), "b": seasonal_series(31, 2), "short": seasonal_series(m - 1, 3)}
    series["a"][20] = np.nan
    got = decompose.seasonal_decompose(panel(spark, series), m, mode).toPandas().sort_values(["series_id", "ds"])
    for name, y in series.items():
        own = got[got["series_id"] == name]
        for c, want in zip(("trend", "seasonal", "resid"), reference(y, m, mode)):
            np.testing.assert_allclose(own[c].to_numpy(dtype=float), want, atol=1e-9, equal_nan=True)


def long_series(spark, sizes, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for j, (name, n) in enumerate(sizes.items()):
        at = np.sort(rng.choice((3600 if j == 0 else 86400 * 30) * 1000, size=n, replace=False))
        values = 5 + 0.01 * np.arange(n) + np.tile([0, 2, -1, 4, -5], n)[:n] + rng.normal(0, 0.1, n)
        rows += [(name, START + dt.timedelta(milliseconds=int(t)), i, float(v)) for i, (t, v) in enumerate(zip(at, values))]
    rng.shuffle(rows)
    rows = [(n, t, int(i), float(v)) for n, t, i, v in rows]
    return spark.createDataFrame(rows, "series_id string, ds timestamp_ntz, row_no int, y double")


@pytest.mark.parametrize("width", [None, 3_600_000_000, 40_000_000, 700_000])
def test_long_series_cut_into_chunks_give_the_same(spark, width):
    sizes = {"hot": 400, "b": 37, "c": 3}
    frame = long_series(spark, sizes)
    chunk = None if width is None else F.floor(F.unix_micros(F.col("ds").cast("timestamp")) / width)
    got = decompose.seasonal_decompose(frame, 5, chunk=chunk).toPandas().sort_values(["series_id", "row_no"])
    assert len(got) == sum(sizes.values())
    for name in sizes:
        own = got[got["series_id"] == name]
        for c, want in zip(("trend", "seasonal", "resid"), reference(own["y"].to_numpy(), 5, "additive")):
            np.testing.assert_allclose(own[c].to_numpy(dtype=float), want, atol=1e-9, equal_nan=True)


def test_frames_look_both_ways_over_chunk_borders(spark):
    frame = long_series(spark, {"hot": 200, "b": 11}, 3)
    chunk = F.floor(F.unix_micros(F.col("ds").cast("timestamp")) / 9_000_000)

    def build(w, position, total):
        return {
            "s": F.sum("y").over(w.rowsBetween(-4, 6)),
            "next": F.lead("y", 6).over(w),
            "last": F.lag("y", 4).over(w),
            "pos": position,
        }

    got = ordered.over_rows(frame, ["series_id"], ["ds"], 4, build, chunk, ahead=6).toPandas()
    got = got.sort_values(["series_id", "row_no"])
    for _, own in got.groupby("series_id"):
        y = own["y"].reset_index(drop=True)
        want = [y[max(i - 4, 0) : i + 7].sum() for i in range(len(y))]
        np.testing.assert_allclose(own["s"], want)
        np.testing.assert_allclose(own["next"].astype(float), y.shift(-6), equal_nan=True)
        np.testing.assert_allclose(own["last"].astype(float), y.shift(4), equal_nan=True)
        assert own["pos"].tolist() == list(range(1, len(y) + 1))


def test_zero_trend_and_wrong_arguments(spark):
    flat = panel(spark, {"z": np.zeros(30)})
    parts = decompose.seasonal_decompose(flat, 4, "multiplicative").toPandas()
    assert parts["seasonal"].isna().all() and parts["resid"].isna().all()
    with pytest.raises(ValueError):
        decompose.seasonal_decompose(flat, 1)
    with pytest.raises(ValueError):
        decompose.seasonal_decompose(flat, 4, "other")
    assert pd.isna(parts["trend"]).sum() == 4
