"""Trend plus seasonality plus regressors, additive or multiplicative, for every series at once.

Design columns: constant, scaled time, hinges at change points, Fourier terms, standardised
regressors. Coefficients are penalised least squares with normal priors, solved from one Gram
matrix per series and knot count: all prior scales of a grid share it. The multiplicative form
weights the seasonal and regressor columns with a base trend, taken from the first Gram matrix, so
it needs one more pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.expressions import (
    days_since_epoch,
    dot,
    fourier_terms,
    hinge,
    named,
)
from panelcast.operators.gram import gram
from panelcast.operators.lineage import attach_facts, cut
from panelcast.operators.stationarity import longest_series

# Prior deviations of the additive trend model on scaled data.
TREND_PRIOR = 5.0
SEASON_PRIOR = 10.0
KNOT_SHARE = 0.8

Trial = Mapping[str, object]


def _ridge(width: int, trend: int):
    """Column function (n, gram, prior scales) -> one (beta, sigma) per prior scale.

    The hinge prior has the variance of a Laplace prior, 2 tau^2. The penalty depends on the noise
    variance, which is updated a few times from the residuals.
    """

    @F.pandas_udf("array<struct<beta:array<double>, sigma:double>>")
    def solve(n: pd.Series, grams: pd.Series, scales: pd.Series) -> pd.Series:
        batch, k = len(n), width - 1
        g = np.zeros((batch, width, width))
        upper = np.triu_indices(width)
        if batch:
            g[:, upper[0], upper[1]] = np.vstack(grams.to_numpy())
            g[:, upper[1], upper[0]] = g[:, upper[0], upper[1]]
        xx, xy, yy = g[:, :k, :k], g[:, :k, k], g[:, k, k]
        rows = np.maximum(n.to_numpy(dtype=float), 1.0)
        counts = np.array([len(s) for s in scales], dtype=int)
        taus = np.ones((batch, counts.max(initial=0)))
        for b, s in enumerate(scales):
            taus[b, : len(s)] = s
        results: list[list] = [[] for _ in range(batch)]
        for j in range(taus.shape[1]):
            precision = np.empty((batch, k))
            precision[:, :2] = 1.0 / TREND_PRIOR**2
            precision[:, 2:trend] = 1.0 / (2.0 * taus[:, j : j + 1] ** 2)
            precision[:, trend:] = 1.0 / SEASON_PRIOR**2
            noise = np.full(batch, 0.01)
            for _ in range(6):
                a = xx + noise[:, None, None] * precision[:, :, None] * np.eye(k)
                beta = np.linalg.solve(a, xy[:, :, None])[:, :, 0]
                sse = (
                    yy
                    - 2.0 * np.einsum("bi,bi->b", beta, xy)
                    + np.einsum("bi,bij,bj->b", beta, xx, beta)
                )
                noise = np.maximum(sse / rows, 1e-8)
            for b in np.flatnonzero(counts > j):
                results[b].append({"beta": beta[b], "sigma": float(np.sqrt(noise[b]))})
        return pd.Series(results)

    return solve


def _facts(panel: DataFrame, exog: Sequence[str], y: str, ds: str, by: Sequence[str]) -> DataFrame:
    """Per series: time span, size of y, centre and deviation of each regressor."""
    days = days_since_epoch(panel, ds)
    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        F.min(days).alias("t_start"),
        F.max(days).alias("t_end"),
        F.max(F.abs(named(y))).alias("y_scale"),
    ]
    means, deviations = [], []
    for c in exog:
        sd = F.stddev_pop(named(c))
        means.append(F.avg(named(c)))
        deviations.append(F.when(sd > 0, sd).otherwise(1.0))
    aggs.append(F.array(*means).cast("array<double>").alias("x_mean"))
    aggs.append(F.array(*deviations).cast("array<double>").alias("x_scale"))
    facts = panel.groupBy(*[named(c) for c in by]).agg(*aggs)
    return facts.withColumn(
        "y_scale", F.when(F.col("y_scale") > 0, F.col("y_scale")).otherwise(1.0)
    )


def _trend_terms(df: DataFrame, ds: str, knots: int) -> list[Column]:
    """Constant, time and hinges; the knot count of a row is its column ``n_knots``."""
    days = days_since_epoch(df, ds)
    span = F.nullif(F.col("t_end") - F.col("t_start"), F.lit(0.0))
    t = F.coalesce((days - F.col("t_start")) / span, F.lit(0.0))
    hinges = [
        F.when(
            F.col("n_knots") >= j, hinge(t, F.lit(KNOT_SHARE * j) / F.col("n_knots"))
        ).otherwise(F.lit(0.0))
        for j in range(1, knots + 1)
    ]
    return [F.lit(1.0), t, *hinges]


def _season_terms(
    df: DataFrame, ds: str, period: float, order: int, exog: Sequence[str]
) -> list[Column]:
    waves = [c for _, c in fourier_terms(days_since_epoch(df, ds), period, order)]
    drivers = [
        (named(c) - F.get("x_mean", F.lit(i))) / F.get("x_scale", F.lit(i))
        for i, c in enumerate(exog)
    ]
    return waves + drivers


def _designs(trials: Sequence[Trial]) -> dict[tuple[str, int], list[tuple[int, float]]]:
    """(mode, knots) -> [(trial id, prior scale)]; ids count from 1 in the given order."""
    designs: dict[tuple[str, int], list[tuple[int, float]]] = {}
    for number, trial in enumerate(trials, 1):
        key = (str(trial["seasonality_mode"]), int(trial["n_changepoints"]))
        designs.setdefault(key, []).append((number, float(trial["changepoint_prior_scale"])))
    return designs


def fit_trend_season(
    panel: DataFrame,
    trials: Sequence[Trial],
    exog: Sequence[str] = (),
    period: float = 365.25,
    fourier_order: int = 5,
    y: str = "y",
    ds: str = "ds",
    by: Sequence[str] = ("series_id",),
    chosen: DataFrame | None = None,
) -> DataFrame:
    """One model row per series and trial.

    A trial names ``seasonality_mode`` ('additive' or 'multiplicative'), ``n_changepoints`` and
    ``changepoint_prior_scale``. Knots are clipped per series to the first 80 % of its rows.
    ``chosen`` (by, trial_id) names one trial per series; only its design is formed and solved.
    """
    keys = [named(c) for c in by]
    rows = panel.select(*keys, named(ds), named(y), *[named(c) for c in exog]).na.drop(
        subset=[y, *exog]
    )
    designs = _designs(trials)
    knots = max(n for _, n in designs)
    # Knots beyond the longest history would only widen the design with zeros.
    knots = min(knots, max(int(KNOT_SHARE * longest_series(rows, by)) - 1, 0))
    facts = _facts(rows, exog, y, ds, by)
    if chosen is not None:
        listed = [
            (number, str(t["seasonality_mode"]), int(t["n_changepoints"]))
            for number, t in enumerate(trials, 1)
        ]
        picked = F.array(
            *[F.struct(*[F.lit(x).alias(n) for x, n in zip(t, ("id", "mode", "knots"))]) for t in listed]
        )
        one = F.element_at(picked, F.col("trial_id"))
        wanted_design = chosen.select(
            *keys,
            F.col("trial_id").alias("__trial"),
            one.getField("mode").alias("__mode"),
            one.getField("knots").alias("__knots"),
        )
        facts = facts.join(wanted_design, list(by))
    facts = cut(facts)
    joined = attach_facts(rows, facts, by, "inner", stored=True)
    counts = sorted({n for _, n in designs})
    room = F.greatest(F.floor(F.col("n_rows") * KNOT_SHARE) - 1, F.lit(0))

    def with_knots(frame: DataFrame) -> DataFrame:
        return frame.withColumn("n_knots", F.least(F.col("n_changepoints"), room).cast("int"))

    def spread(frame: DataFrame, requested: Sequence[int]) -> DataFrame:
        if chosen is not None:
            own = frame.filter(F.col("__knots").isin(list(requested)))
            return with_knots(own.withColumn("n_changepoints", F.col("__knots")))
        asked = F.explode(F.array(*[F.lit(n) for n in requested]))
        return with_knots(frame.select("*", asked.alias("n_changepoints")))

    kept = ("t_start", "t_end", "y_scale", "x_mean", "x_scale", "n_knots", "n_rows")
    # The facts come back to the sums by a join of small tables: arrays among the aggregates
    # would force a sort of the data rows.
    group = [*by, "n_changepoints"]
    trend_width = 2 + knots
    target = named(y) / F.col("y_scale")

    def passes(frame: DataFrame, weight: Column | None) -> DataFrame:
        season = _season_terms(frame, ds, period, fourier_order, exog)
        if weight is not None:
            season = [weight * c for c in season]
        terms = [*_trend_terms(frame, ds, knots), *season, target]
        return with_knots(gram(frame, group, terms).join(facts, list(by)))

    n_terms = trend_width + 2 * fourier_order + len(exog)
    ridge = _ridge(n_terms + 1, trend_width)

    def per_design(mode: str, pick: int, kind: str) -> Column:
        """Trial ids or prior scales of a mode, by the knot count of the row."""
        chosen = F.lit(None).cast(f"array<{kind}>")
        for (m, n), entries in designs.items():
            if m == mode:
                values = F.array(*[F.lit(e[pick]) for e in entries])
                chosen = F.when(F.col("n_changepoints") == n, values).otherwise(chosen)
        return chosen

    def solved(sums: DataFrame, mode: str) -> DataFrame:
        """Every trial of a mode; the scales of all its knot counts are solved in one step."""
        wanted = [n for m, n in designs if m == mode]
        fits = sums.filter(F.col("n_changepoints").isin(wanted)).select(
            *[named(c) for c in group],
            *kept,
            per_design(mode, 0, "int").alias("trial_id"),
            per_design(mode, 1, "double").alias("tau"),
            ridge("n", "gram", per_design(mode, 1, "double")).alias("fits"),
        )
        return fits.select(
            *[named(c) for c in group], *kept, F.inline(F.arrays_zip("trial_id", "tau", "fits"))
        ).select(
            *keys,
            "trial_id",
            F.lit(mode).alias("seasonality_mode"),
            "n_changepoints",
            F.col("tau").alias("changepoint_prior_scale"),
            "n_knots",
            F.col("n_rows").alias("n_obs"),
            F.col("fits.beta").alias("beta"),
            F.col("fits.sigma").alias("sigma"),
            "t_start",
            "t_end",
            "y_scale",
            "x_mean",
            "x_scale",
        )

    results = []
    # Both modes start from these sums: one small row per series and knot count.
    additive = cut(passes(spread(joined, counts), None))
    if any(mode == "additive" for mode, _ in designs):
        results.append(solved(additive, "additive"))
    weighted_counts = sorted({n for mode, n in designs if mode == "multiplicative"})
    if weighted_counts:
        base_scale = F.array(F.lit(min(t for e in designs.values() for _, t in e)))
        base = additive.filter(F.col("n_changepoints").isin(weighted_counts)).select(
            *keys,
            "n_changepoints",
            F.get(ridge("n", "gram", base_scale), F.lit(0)).getField("beta").alias("base"),
        )
        weighted = joined
        if chosen is not None:
            weighted = joined.filter(F.col("__mode") == "multiplicative")
        frame = attach_facts(spread(weighted, weighted_counts), base, group, "inner")
        trend = _trend_terms(frame, ds, knots)
        weight = dot(F.slice("base", 1, trend_width), F.array(*trend))
        results.append(solved(passes(frame, weight), "multiplicative"))
    model = results[0]
    for more in results[1:]:
        model = model.unionByName(more)
    if chosen is not None:
        model = model.join(chosen.select(*keys, "trial_id"), [*by, "trial_id"], "left_semi")
    return model


def predict_trend_season(
    model: DataFrame,
    rows: DataFrame,
    exog: Sequence[str] = (),
    period: float = 365.25,
    fourier_order: int = 5,
    interval_width: float = 0.8,
    ds: str = "ds",
    by: Sequence[str] = ("series_id",),
    keep: Sequence[str] = (),
) -> DataFrame:
    """(by, ds, keep, trial_id, yhat, yhat_lower, yhat_upper) for every row and model of its series.

    Rows of a series without a model come once, with NULLs.
    The interval covers the residual noise only, not the uncertainty of the future trend.
    """
    keys = [named(c) for c in by]
    taken = dict.fromkeys([*exog, *[c for c in keep if c in rows.columns]])
    frame = attach_facts(
        rows.select(*keys, named(ds), *[named(c) for c in taken]), model, by, "left"
    )
    season = _season_terms(frame, ds, period, fourier_order, exog)
    width = F.size("beta") - len(season)
    days = days_since_epoch(frame, ds)
    span = F.nullif(F.col("t_end") - F.col("t_start"), F.lit(0.0))
    t = F.coalesce((days - F.col("t_start")) / span, F.lit(0.0))
    beta = F.col("beta")
    bends = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.col("n_knots"), F.lit(1))),
        F.lit(0.0),
        lambda total, j: total
        + F.when(
            F.col("n_knots") >= j,
            F.get(beta, j + 1) * hinge(t, F.lit(KNOT_SHARE) * j / F.col("n_knots")),
        ).otherwise(F.lit(0.0)),
    )
    trend = F.get(beta, F.lit(0)) + F.get(beta, F.lit(1)) * t + bends
    rest = F.lit(0.0)
    if season:
        rest = dot(F.slice(beta, width + 1, len(season)), F.array(*season))
    scaled = F.when(
        F.col("seasonality_mode") == "multiplicative", trend * (F.lit(1.0) + rest)
    ).otherwise(trend + rest)
    reach = F.lit(NormalDist().inv_cdf(0.5 + interval_width / 2)) * F.col("sigma")
    return frame.select(
        *keys,
        named(ds),
        *[named(c) for c in keep],
        "trial_id",
        (scaled * F.col("y_scale")).alias("yhat"),
        ((scaled - reach) * F.col("y_scale")).alias("yhat_lower"),
        ((scaled + reach) * F.col("y_scale")).alias("yhat_upper"),
    )
