"""Small panels with known properties, and plain numpy references."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd


def months(n: int, start: str = "2015-01-01") -> list[dt.date]:
    return [d.date() for d in pd.date_range(start, periods=n, freq="MS")]


def panel(spark, series: dict[str, np.ndarray], **exog: dict[str, np.ndarray]):
    rows = []
    for name, y in series.items():
        for i, (ds, v) in enumerate(zip(months(len(y)), y)):
            value = None if np.isnan(v) else float(v)
            rows.append((name, ds, value, *[float(x[name][i]) for x in exog.values()]))
    fields = "series_id string, ds date, y double" + "".join(f", {c} double" for c in exog)
    return spark.createDataFrame(rows, fields)


def seasonal_series(n: int, seed: int, noise: float = 0.3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return 20 + 0.1 * t + 3 * np.sin(2 * np.pi * t / 12) + rng.normal(0, noise, n)


def least_squares(x: np.ndarray, y: np.ndarray):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    residual = y - x @ beta
    sse = float(residual @ residual)
    spread = (np.linalg.pinv(x) ** 2).sum(axis=1)
    se = np.sqrt(spread * sse / max(len(y) - x.shape[1], 1))
    return beta, se, sse


def rows_of(df, *order: str) -> list[tuple]:
    return [tuple(r) for r in df.orderBy(*order).collect()]
