"""Scores, alignment of forecasts with actuals, trial logs and choice of the best trial."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.expressions import missing_to_null, named
from panelcast.operators.shape import KEY

EPSILON = 2.220446049250313e-16  # fixed value: smallest divisor of a percentage error


def metrics(
    df: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()
) -> DataFrame:
    """n, R2, MAE, MAPE (a fraction) and MSE in one pass, per group if asked.

    Rows with a missing value (NULL or NaN) on either side do not count. The spread of ``y`` comes from a running variance, not from a second pass for its mean.
    """
    pair = df.withColumns({c: missing_to_null(named(c)) for c in (y, yhat)})
    pair = pair.filter(named(y).isNotNull() & named(yhat).isNotNull())
    error = named(y) - named(yhat)
    spread = F.var_pop(named(y)) * F.count(F.lit(1))
    return pair.groupBy(*[named(c) for c in by]).agg(
        F.count(F.lit(1)).alias("n"),
        (F.lit(1.0) - F.sum(error * error) / F.nullif(spread, F.lit(0.0))).alias("r2"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(F.abs(error) / F.greatest(F.abs(named(y)), F.lit(EPSILON))).alias("mape"),
        F.avg(error * error).alias("mse"),
    )


def align_forecast(
    actual: DataFrame, forecast: DataFrame, keys: Sequence[str] = KEY, yhat: str = "yhat"
) -> DataFrame:
    """Actuals next to forecasts by key. Rows without a partner are left out."""
    right = forecast.select(*[named(c) for c in keys], named(yhat))
    return actual.join(right, list(keys), "inner")


def comparison_frame(
    panel: DataFrame,
    forecast: DataFrame,
    split: str = "split",
    keys: Sequence[str] = KEY,
) -> DataFrame:
    """Long table (keys, kind, value): the actual values tagged by split, and the predictions."""
    key_cols = [named(c) for c in keys]
    actual = panel.select(*key_cols, named(split).alias("kind"), named("y").alias("value"))
    predicted = forecast.select(
        *key_cols, F.lit("predicted").alias("kind"), named("yhat").alias("value")
    )
    return actual.unionByName(predicted)


def union_trials(logs: Sequence[DataFrame]) -> DataFrame:
    """One trial log out of several."""
    return reduce(lambda a, b: a.unionByName(b), logs)


def cv_mean_score(
    folds: DataFrame, score: str = "r2", by: Sequence[str] = ("trial_id",)
) -> DataFrame:
    """Mean of the fold scores of each trial (not the score of the pooled rows)."""
    return folds.groupBy(*[named(c) for c in by]).agg(F.avg(named(score)).alias("mean_score"))


def best_trial(
    trials: DataFrame,
    metric: str,
    mode: str = "min",
    by: Sequence[str] = (),
    trial: str = "trial_id",
) -> DataFrame:
    """The whole best row per group; on equal scores the smaller trial id wins.

    A partial aggregate: each task keeps one candidate per group, nothing is sorted.
    """
    if mode not in ("min", "max"):
        raise ValueError("mode must be 'min' or 'max'")
    score = named(metric) if mode == "min" else -named(metric)
    rest = [c for c in trials.columns if c not in by]
    chosen = F.min_by(F.struct(*[named(c) for c in rest]), F.struct(score, named(trial)))
    scored = trials.filter(named(metric).isNotNull() & ~F.isnan(named(metric)))
    best = scored.groupBy(*[named(c) for c in by]).agg(chosen.alias("__best"))
    return best.select(*[named(c) for c in by], "__best.*")
