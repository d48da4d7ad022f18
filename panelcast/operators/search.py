"""Grid search of the trend model over all series in one job, and the forecast of the best."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from panelcast.functions.expressions import named
from panelcast.operators.grid import grid_points
from panelcast.operators.lineage import cut
from panelcast.operators.metrics import best_trial, metrics
from panelcast.operators.trend_season import fit_trend_season, predict_trend_season

PARAMETERS = ("changepoint_prior_scale", "n_changepoints", "seasonality_mode")


def forecast_grid_search(
    train: DataFrame,
    validate: DataFrame,
    grid: Mapping[str, Sequence[object]],
    exog: Sequence[str] = (),
    period: float = 365.25,
    fourier_order: int = 5,
    by: Sequence[str] = ("series_id",),
) -> DataFrame:
    """Scores of every trial on the validation rows: (by, trial_id, parameters, n, mape, mae, ...).

    Trials are rows, not jobs: data is reduced once per design, each trial is a small solve, and
    the scores of all trials come from one aggregation.
    """
    model = fit_trend_season(train, grid_points(grid), exog, period, fourier_order, by=by)
    predicted = predict_trend_season(
        model, validate, exog, period, fourier_order, by=by, keep=["y", *PARAMETERS]
    )
    return metrics(predicted, by=[*by, "trial_id", *PARAMETERS])


def best_forecast(
    train: DataFrame,
    validate: DataFrame,
    future: DataFrame,
    grid: Mapping[str, Sequence[object]],
    exog: Sequence[str] = (),
    period: float = 365.25,
    fourier_order: int = 5,
    interval_width: float = 0.95,
    by: Sequence[str] = ("series_id",),
) -> DataFrame:
    """Choose each series' best trial on ``validate``, refit on train and validate, forecast.

    The test rows take no part in the choice. The refit forms and solves the chosen trial of each
    series alone.
    """
    scores = forecast_grid_search(train, validate, grid, exog, period, fourier_order, by)
    best = cut(best_trial(scores, "mape", "min", by).select(*[named(c) for c in by], "trial_id"))
    everything = train.unionByName(validate)
    refit = fit_trend_season(
        everything, grid_points(grid), exog, period, fourier_order, by=by, chosen=best
    )
    return predict_trend_season(
        refit, future, exog, period, fourier_order, interval_width, by=by
    )
