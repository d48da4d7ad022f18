"""Registered queries. Each takes (spark, sf_dir), reads whole tables and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml import Estimator
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.expressions import changepoint_features as add_changepoints
from panelcast.functions.expressions import fourier_features as add_fourier
from panelcast.functions.names import feature_cols
from panelcast.operators import (
    attribution,
    decompose,
    grid,
    metrics,
    ordered,
    penalized,
    quantiles,
    sarx,
    screening,
    search,
    shape,
    smoothing,
    stationarity,
    stats,
    trees,
    trend_season,
    vector_auto,
)
from panelcast.operators.lineage import cut, ensure_checkpoint_dir
from panelcast.plans import market
from panelcast.plans.market import MODEL_FEATURES
from panelcast.sources import load_panel

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

KEYS = ["date", "measure", "geography", "product"]
GRID = {
    "seasonality_mode": ["multiplicative", "additive"],
    "changepoint_prior_scale": [0.1, 0.2, 0.3, 0.4, 0.5],
    "n_changepoints": [4, 8, 12],
}
WIDE_GRID = {**GRID, "n_changepoints": [100, 150, 200]}
HORIZON = 12


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int = 5, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round the double columns, so that both engines print the same digits."""
    return df.select(
        *[
            F.round(f"`{name}`", digits).alias(name)
            if kind == "double" and name not in skip
            else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
    )


# --- flagship ------------------------------------------------------------------------------------


@query
def market_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly size per segment with its 3-month mean, first difference and scaled value."""
    panel = market.market_size(spark, sf)
    panel = ordered.rolling_mean(panel, "y", 3, name="mean_3")
    panel = ordered.difference(panel, "y", name="diff_1")
    panel = panel.withColumn("scaled", F.col("y"))
    return rounded(stats.minmax_scale(panel, ["scaled"], by=["series_id"]))


# --- scans, projections, filters -----------------------------------------------------------------


@query
def scan_panel(spark: SparkSession, sf: str) -> DataFrame:
    orders = load_panel(spark, f"{sf}/orders.parquet", "parquet")
    return orders.select("o_orderkey", F.to_date("o_orderdate").alias("ds"), "o_totalprice")


@query
def scan_table(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows by a name in the catalog."""
    spark.read.parquet(f"{sf}/orders.parquet").createOrReplaceTempView("orders_panel")
    orders = load_panel(spark, "orders_panel", "table")
    return orders.select("o_orderkey", F.to_date("o_orderdate").alias("ds"), "o_totalprice")


@query
def scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The wide text table as headered CSV, written below the checkpoint folder and read as text."""
    folder = f"{ensure_checkpoint_dir(spark)}/panel-{uuid.uuid4().hex}"
    market.long_panel(spark, sf).write.csv(folder, header=True)
    return load_panel(spark, folder, "csv")


@query
def filter_measure(spark: SparkSession, sf: str) -> DataFrame:
    return shape.slice_panel(market.long_panel(spark, sf), measure="volume").select(
        *KEYS, "total_market"
    )


@query
def filter_product(spark: SparkSession, sf: str) -> DataFrame:
    return shape.slice_panel(
        market.long_panel(spark, sf), measure="volume", product="BUILDING"
    ).select(*KEYS, "total_market")


@query
def drop_columns(spark: SparkSession, sf: str) -> DataFrame:
    volume = shape.slice_panel(market.long_panel(spark, sf), measure="volume")
    return volume.drop("measure", "own_share", *market.LONG_DRIVERS)


@query
def regex_drop(spark: SparkSession, sf: str) -> DataFrame:
    return shape.drop_matching(market.long_panel(spark, sf), "FCT")


@query
def regex_variant(spark: SparkSession, sf: str) -> DataFrame:
    return shape.keep_variant(market.long_panel(spark, sf), "Ncov", "cov")


@query
def cast_numeric(spark: SparkSession, sf: str) -> DataFrame:
    panel = market.long_panel(spark, sf)
    return shape.cast_numeric(panel, feature_cols(panel.columns, KEYS))


@query
def parse_date(spark: SparkSession, sf: str) -> DataFrame:
    panel = market.long_panel(spark, sf).select(*KEYS, "total_market")
    return shape.parse_ds(panel, "date")


@query
def feature_target_split(spark: SparkSession, sf: str) -> DataFrame:
    features, _ = shape.split_target(
        market.long_panel(spark, sf), KEYS, ["total_market", "own_share"]
    )
    return features


@query
def rename_contract(spark: SparkSession, sf: str) -> DataFrame:
    panel = market.long_panel(spark, sf).select(*KEYS, "total_market")
    return shape.to_model_frame(panel)


@query
def date_range_filter(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        shape.between_dates(market.market_size(spark, sf), "1998-01-01", "1998-12-01")
    )


@query
def strip_tz(spark: SparkSession, sf: str) -> DataFrame:
    events = market.event_rows(spark, sf).select(
        "event_id", F.col("ds").cast("timestamp").alias("ds")
    )
    return shape.strip_tz(events).select(
        "event_id", "ds", F.trunc("ds", "MM").alias("month")
    )


# --- joins ---------------------------------------------------------------------------------------


def _scaled_features(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    panel = market.model_panel(spark, sf)
    return panel, stats.minmax_scale(panel, MODEL_FEATURES).drop("y")


@query
def left_join_features(spark: SparkSession, sf: str) -> DataFrame:
    panel, scaled = _scaled_features(spark, sf)
    # Features exist for complete months only; the dates without them stay.
    known = scaled.filter(F.month("ds") != 12)
    return rounded(shape.attach_features(panel.select("series_id", "ds"), known), 6)


@query
def join_target(spark: SparkSession, sf: str) -> DataFrame:
    panel, scaled = _scaled_features(spark, sf)
    return rounded(shape.attach_column(scaled, panel, "y"), 6)


@query
def align_actual_forecast(spark: SparkSession, sf: str) -> DataFrame:
    panel = market.market_size(spark, sf)
    return rounded(metrics.align_forecast(panel, market.naive_forecast(panel)))


@query
def actual_vs_forecast(spark: SparkSession, sf: str) -> DataFrame:
    panel = market.market_size(spark, sf)
    split = ordered.time_split(panel, n_train=48)
    return rounded(metrics.comparison_frame(split, market.naive_forecast(panel)))


def _all_series(spark: SparkSession, sf: str) -> DataFrame:
    return market.sales(spark, sf).select(
        F.concat_ws("/", "geography", "product").alias("series_id")
    ).distinct()


@query
def param_grid(spark: SparkSession, sf: str) -> DataFrame:
    return grid.param_grid(_all_series(spark, sf), WIDE_GRID)


@query
def param_grid_count(spark: SparkSession, sf: str) -> DataFrame:
    trials = grid.param_grid(_all_series(spark, sf), WIDE_GRID)
    return trials.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_trials"))


# --- aggregations --------------------------------------------------------------------------------


@query
def feature_minmax_stats(spark: SparkSession, sf: str) -> DataFrame:
    panel = market.model_panel(spark, sf)
    return rounded(stats.column_stats(panel, MODEL_FEATURES, ["series_id"]), 6)


def _naive_scores(spark: SparkSession, sf: str) -> DataFrame:
    panel = market.market_size(spark, sf)
    aligned = metrics.align_forecast(panel, market.naive_forecast(panel))
    return metrics.metrics(aligned, by=["series_id"])


@query
def metric_r2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_naive_scores(spark, sf).select("series_id", "n", "r2"), 6)


@query
def metric_mae(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_naive_scores(spark, sf).select("series_id", "n", "mae", "mse"), 4)


@query
def metric_mape(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_naive_scores(spark, sf).select("series_id", "n", "mape"), 6)


SMOOTHING = [1, 2, 3, 6, 12]


def _smoothing_trials(spark: SparkSession, sf: str) -> DataFrame:
    """Trial log without a fitted model: the forecast of trial k is the mean of the k rows before.

    All trials share one window pass; each trial is a column that becomes a row.
    """
    panel = market.market_size(spark, sf)

    def build(w, position, total):
        return {
            f"f_{k}": F.when(
                F.count("y").over(w.rowsBetween(-k, -1)) == k,
                F.avg("y").over(w.rowsBetween(-k, -1)),
            )
            for k in SMOOTHING
        }

    wide = ordered.over_rows(panel, ["series_id"], ["ds"], max(SMOOTHING), build)
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("trial_id"), F.lit(k).alias("window"), F.col(f"f_{k}").alias("yhat"))
            for i, k in enumerate(SMOOTHING, 1)
        ]
    )
    rows = wide.select("series_id", "ds", "y", F.inline(entries))
    return metrics.metrics(rows, by=["series_id", "trial_id", "window"])


@query
def best_params_by_metric(spark: SparkSession, sf: str) -> DataFrame:
    trials = _smoothing_trials(spark, sf).select("series_id", "trial_id", "window", "mape")
    return rounded(metrics.best_trial(trials, "mape", "min", ["series_id"]), 6)


@query
def union_trials(spark: SparkSession, sf: str) -> DataFrame:
    scores = _smoothing_trials(spark, sf)
    naive = _naive_scores(spark, sf).select(
        "series_id", F.lit(0).alias("trial_id"), F.lit(0).alias("window"), "n", "mape"
    )
    log = metrics.union_trials([scores.select(*naive.columns), naive])
    return rounded(log, 6)


@query
def cv_mean_score(spark: SparkSession, sf: str) -> DataFrame:
    panel = ordered.time_folds(market.market_size(spark, sf), 5)
    aligned = metrics.align_forecast(panel, market.naive_forecast(panel))
    folds = metrics.metrics(aligned, by=["series_id", "fold"])
    return rounded(metrics.cv_mean_score(folds, "mape", ["series_id"]), 6)


@query
def corr_prune(spark: SparkSession, sf: str) -> DataFrame:
    panel = market.model_panel(spark, sf, fine=True)
    return stats.correlated_columns(panel, ["y", *MODEL_FEATURES], 0.5)


@query
def standard_scale(spark: SparkSession, sf: str) -> DataFrame:
    panel = market.model_panel(spark, sf)
    return rounded(stats.standardize(panel, MODEL_FEATURES).drop("y"), 6)


@query
def minmax_scale(spark: SparkSession, sf: str) -> DataFrame:
    panel = market.model_panel(spark, sf).withColumn("x_flat", F.lit(1.0))
    return rounded(stats.minmax_scale(panel, [*MODEL_FEATURES, "x_flat"]).drop("y"), 6)


def _with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Quantity missing in every fourth month, price in every sixth."""
    panel = market.model_panel(spark, sf).select("series_id", "ds", "y", "x_qty", "x_price")
    month = F.month("ds")
    return panel.withColumns(
        {
            "x_qty": F.when(month % 4 != 0, F.col("x_qty")),
            "x_price": F.when(month % 6 != 0, F.col("x_price")),
        }
    )


@query
def fill_target_mean(spark: SparkSession, sf: str) -> DataFrame:
    filled = stats.fill_with_mean_of(_with_gaps(spark, sf), ["x_qty", "x_price"], "y")
    return rounded(filled)


@query
def fill_own_mean(spark: SparkSession, sf: str) -> DataFrame:
    filled = stats.fill_own_mean(
        _with_gaps(spark, sf), ["x_qty", "x_price"], ["series_id"], flag=True
    )
    return rounded(filled)


@query
def drop_missing(spark: SparkSession, sf: str) -> DataFrame:
    steps = ordered.difference(_with_gaps(spark, sf), "x_qty", name="diff")
    return rounded(shape.drop_missing(steps, ["diff"]).select("series_id", "ds", "diff"))


# --- rows in order -------------------------------------------------------------------------------


@query
def rolling_mean_3(spark: SparkSession, sf: str) -> DataFrame:
    panel = _with_gaps(spark, sf).select("series_id", "ds", F.col("x_qty").alias("y"))
    return rounded(ordered.rolling_mean(panel, "y", 3, name="mean_3"))


@query
def first_difference(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ordered.difference(market.market_size(spark, sf), "y", name="diff_1"))


@query
def lag_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ordered.lag_matrix(market.market_size(spark, sf), "y", [1, 2, 3, 12]))


@query
def time_split(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ordered.time_split(market.market_size(spark, sf), n_train=48))


@query
def contiguous_folds(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ordered.time_folds(market.market_size(spark, sf), 10))


@query
def series_folds(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.series_folds(
        market.event_rows(spark, sf).drop("value"), 10, order=["ds", "event_id"]
    )


@query
def random_holdout(spark: SparkSession, sf: str) -> DataFrame:
    panel = market.model_panel(spark, sf, fine=True).select("series_id", "ds")
    return ordered.random_split(panel, ["series_id", "ds"], 0.2, 21)


@query
def event_rolling_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Trailing mean over raw events: five series hold all rows and are cut into chunks."""
    rows = ordered.rolling_mean(
        market.event_rows(spark, sf), "value", 3, order=["ds", "event_id"], name="mean_3"
    )
    return rounded(rows.select("event_id", "mean_3"))


@query
def event_difference(spark: SparkSession, sf: str) -> DataFrame:
    rows = ordered.difference(
        market.event_rows(spark, sf), "value", order=["ds", "event_id"], name="diff_1"
    )
    return rounded(rows.select("event_id", "diff_1"))


@query
def event_lags(spark: SparkSession, sf: str) -> DataFrame:
    rows = ordered.lag_matrix(
        market.event_rows(spark, sf), "value", [1, 5, 24], order=["ds", "event_id"]
    )
    return rows.select("event_id", "value_lag_1", "value_lag_5", "value_lag_24")


@query
def event_time_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = ordered.time_split(
        market.event_rows(spark, sf), horizon=100, order=["ds", "event_id"]
    )
    return rows.select("event_id", "split")


@query
def sort_by_date(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(shape.sort_by_date(market.market_size(spark, sf)))


@query
def topk_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(shape.top_k(market.market_size(spark, sf), "y", 15, ["ds"], ["series_id"]))


@query
def densify_panel(spark: SparkSession, sf: str) -> DataFrame:
    panel = (
        market.sales(spark, sf)
        .groupBy(F.concat_ws("/", "geography", "product").alias("series_id"), "ds")
        .agg((F.sum("price_c").cast("double") / 1e5).alias("y"))
    )
    return rounded(shape.densify(panel))


# --- time features -------------------------------------------------------------------------------


@query
def fourier_features(spark: SparkSession, sf: str) -> DataFrame:
    panel = market.market_size(spark, sf).select("series_id", "ds")
    return rounded(add_fourier(panel, 30.0, 5), 6)


@query
def changepoint_features(spark: SparkSession, sf: str) -> DataFrame:
    panel = market.market_size(spark, sf).select(
        "series_id", "ds", F.unix_date("ds").cast("double").alias("t")
    )
    scaled = stats.minmax_scale(panel, ["t"], by=["series_id"])
    return rounded(add_changepoints(scaled, 8), 6)


# --- stationarity --------------------------------------------------------------------------------


@query
def df_test_lag0(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stationarity.df_test(market.market_size(spark, sf)))


@query
def adf_test(spark: SparkSession, sf: str) -> DataFrame:
    panel = cut(market.model_panel(spark, sf, fine=True))
    return rounded(stationarity.adf_test(panel, max_lag=None))


@query
def adf_test_difference(spark: SparkSession, sf: str) -> DataFrame:
    steps = ordered.difference(cut(market.market_size(spark, sf)), "y", name="dy")
    return rounded(stationarity.adf_test(steps.filter("dy is not null"), y="dy"))


@query
def should_diff(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stationarity.should_diff(cut(market.market_size(spark, sf))))


# --- seasonal autoregression ---------------------------------------------------------------------

EXOG = ["x_qty", "x_price"]
ORDERS = sarx.Orders(m=12, history=48)  # what histories of 36 to 71 months come to, for the SQL twins


def _train_test(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    panel = cut(market.model_panel(spark, sf))
    split = ordered.time_split(panel, horizon=HORIZON)
    return (
        split.filter("split = 'train'").drop("split"),
        split.filter("split = 'test'").drop("split"),
    )


@query
def seasonal_strength(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sarx.seasonal_differences(market.market_size(spark, sf)))


@query
def sarx_order_search(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _train_test(spark, sf)
    orders = sarx.fitting_orders(train, EXOG)
    return rounded(sarx.order_search_log(sarx.fit_sarx(train, EXOG, orders, keep_log=True)))


@query
def sarx_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _train_test(spark, sf)
    orders = sarx.fitting_orders(train, EXOG)
    return rounded(sarx.coef_table(sarx.fit_sarx(train, EXOG, orders), EXOG, orders))


@query
def sarx_forecast(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _train_test(spark, sf)
    orders = sarx.fitting_orders(train, EXOG)
    model = sarx.fit_sarx(train, EXOG, orders)
    predicted = sarx.forecast_sarx(model, train, test, EXOG, orders)
    predicted = predicted.withColumn("yhat", F.round("yhat", 3))
    return rounded(metrics.align_forecast(test.select("series_id", "ds", "y"), predicted))


# --- trend and seasonality -----------------------------------------------------------------------


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    panel = cut(market.model_panel(spark, sf))
    split = ordered.three_way_split(panel, HORIZON, HORIZON)
    train, validate, test = (
        split.filter(F.col("split") == name).drop("split")
        for name in ("train", "validate", "test")
    )
    return train, validate, test


ONE_TRIAL = [
    {"seasonality_mode": "additive", "n_changepoints": 8, "changepoint_prior_scale": 0.1}
]


@query
def trend_season_fit(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _train_test(spark, sf)
    model = trend_season.fit_trend_season(train, ONE_TRIAL, EXOG, fourier_order=3)
    return model.select("series_id", "trial_id", "n_knots", "n_obs", F.round("sigma", 6).alias("sigma"))


@query
def trend_season_forecast(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _train_test(spark, sf)
    model = trend_season.fit_trend_season(train, ONE_TRIAL, EXOG, fourier_order=3)
    return rounded(
        trend_season.predict_trend_season(model, test, EXOG, fourier_order=3), 3
    )


def _rounded_scores(scores: DataFrame) -> DataFrame:
    sizes = {c: F.round(c, 2) for c in ("mae", "mse")}
    return rounded(scores.withColumns(sizes), 6)


@query
def forecast_grid(spark: SparkSession, sf: str) -> DataFrame:
    train, validate, _ = _parts(spark, sf)
    scores = search.forecast_grid_search(train, validate, GRID, EXOG, fourier_order=3)
    return _rounded_scores(scores)


@query
def forecast_grid_wide(spark: SparkSession, sf: str) -> DataFrame:
    """The grid with 100 to 200 knots, which each series clips to its history."""
    train, validate, _ = _parts(spark, sf)
    scores = search.forecast_grid_search(train, validate, WIDE_GRID, EXOG, fourier_order=3)
    return _rounded_scores(scores)


@query
def best_forecast(spark: SparkSession, sf: str) -> DataFrame:
    train, validate, test = _parts(spark, sf)
    predicted = search.best_forecast(train, validate, test, GRID, EXOG, fourier_order=3)
    scored = metrics.align_forecast(test.select("series_id", "ds", "y"), predicted)
    scores = metrics.metrics(scored, by=["series_id"])
    return _rounded_scores(scores)


@query
def best_forecast_wide(spark: SparkSession, sf: str) -> DataFrame:
    """The best of the grid with 100 to 200 knots, refitted and scored on the test rows."""
    train, validate, test = _parts(spark, sf)
    predicted = search.best_forecast(train, validate, test, WIDE_GRID, EXOG, fourier_order=3)
    scored = metrics.align_forecast(test.select("series_id", "ds", "y"), predicted)
    return _rounded_scores(metrics.metrics(scored, by=["series_id"]))


def _forecast_with(train: DataFrame, test: DataFrame, best: list[str]) -> DataFrame:
    """Scores of all forecasters on the held-out rows; the regressors' gaps are filled from the training rows."""
    train, test = (
        cut(stats.fill_own_mean(part, best, by=["series_id"], fit_on=train)) for part in (train, test)
    )
    orders = sarx.fitting_orders(train, best)
    seasonal = sarx.forecast_sarx(sarx.fit_sarx(train, best, orders), train, test, best, orders)
    fitted = trend_season.fit_trend_season(train, ONE_TRIAL, best, fourier_order=3)
    trend = trend_season.predict_trend_season(fitted, test, best, fourier_order=3)
    smooth = smoothing.forecast_smoothing(smoothing.fit_smoothing(train), test)
    actual = test.select("series_id", "ds", "y")
    forecasts = metrics.union_trials(
        [
            metrics.align_forecast(actual, predicted).withColumn("forecaster", F.lit(name))
            for name, predicted in (("sarx", seasonal), ("trend", trend), ("smoothing", smooth))
        ]
    )
    return _rounded_scores(metrics.metrics(forecasts, by=["series_id", "forecaster"]))


@query
def driver_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """The whole path: rank drivers by correlation, keep the best, fill gaps, forecast by all models, score.

    Ranking and filling see the training rows only.
    """
    train, test = _train_test(spark, sf)
    pairs = stats.correlations(train, ["y", *MODEL_FEATURES]).filter("earlier = 'y'")
    ranking = pairs.select(
        F.lit("correlation").alias("model"),
        F.col("column").alias("attribute"),
        F.abs("corr").alias("importance"),
    )
    return _forecast_with(train, test, shape.ranked_names(ranking, 2))


@query
def importance_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """The same path from the importance of boosted trees: the first model's ranking of the training rows."""
    train, test = _train_test(spark, sf)
    table, names = trees.prepare(train, MODEL_FEATURES)
    table = trees.laid_out(table)
    ranking = trees.importance_frame(table, trees.gbt(**SMALL_GBT).fit(table), names, "gbt")
    return _forecast_with(train, test, shape.ranked_names(ranking, 2))


# --- decomposition, smoothing, several columns at once -------------------------------------------


def _decomposed(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    """A monthly trend is a whole number of 1/24 of the last digit kept; a nudge below that settles ties."""
    parts = decompose.seasonal_decompose(market.market_size(spark, sf), 12, mode)
    return rounded(parts.withColumn("trend", F.col("trend") + 1e-7))


@query
def decompose_additive(spark: SparkSession, sf: str) -> DataFrame:
    return _decomposed(spark, sf, "additive")


@query
def decompose_multiplicative(spark: SparkSession, sf: str) -> DataFrame:
    return _decomposed(spark, sf, "multiplicative")


@query
def event_decompose(spark: SparkSession, sf: str) -> DataFrame:
    """Raw events by 24 rows: five series hold all rows, the average looks over chunk borders both ways."""
    rows = decompose.seasonal_decompose(
        market.event_rows(spark, sf), 24, y="value", order=["ds", "event_id"]
    )
    return rounded(rows.select("event_id", "trend", "seasonal", "resid"), 6)


WEIGHTS = smoothing.Weights()


@query
def smoothing_search(spark: SparkSession, sf: str) -> DataFrame:
    trials = smoothing.smoothing_trials(market.market_size(spark, sf), WEIGHTS)
    return trials.withColumn("sse", F.round("sse", 1))


def _smoothed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    train, test = _train_test(spark, sf)
    train, test = train.select("series_id", "ds", "y"), test.select("series_id", "ds", "y")
    return cut(smoothing.fit_smoothing(train, WEIGHTS)), train, test


@query
def smoothing_model(spark: SparkSession, sf: str) -> DataFrame:
    model, _, _ = _smoothed(spark, sf)
    state = [F.get("last_state", F.lit(i)).alias(c) for i, c in enumerate(("level", "trend", "next_season"))]
    return rounded(
        model.select("series_id", "trial_id", "alpha", "beta", "gamma", "n", F.round("sse", 1).alias("sse"), *state), 4
    )


@query
def smoothing_fitted(spark: SparkSession, sf: str) -> DataFrame:
    model, train, _ = _smoothed(spark, sf)
    return rounded(smoothing.smoothed_rows(model, train), 4)


@query
def smoothing_forecast(spark: SparkSession, sf: str) -> DataFrame:
    model, _, test = _smoothed(spark, sf)
    predicted = smoothing.forecast_smoothing(model, test)
    return rounded(metrics.align_forecast(test, predicted).join(
        predicted.drop("yhat", "reason"), ["series_id", "ds"]
    ), 3)


VAR_COLUMNS = ["y", "x_qty"]


@query
def var_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _train_test(spark, sf)
    model = vector_auto.fit_var(train, VAR_COLUMNS, 1, fixed=True)
    return rounded(vector_auto.var_coefficients(model, VAR_COLUMNS), 4)


@query
def var_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Joint forecast of size and quantity of every segment over the held-out year."""
    train, test = _train_test(spark, sf)
    model = cut(vector_auto.fit_var(train, VAR_COLUMNS, 1, fixed=True))
    return rounded(vector_auto.forecast_var(model, train, test, VAR_COLUMNS).drop("reason"), 2)


# --- penalised regression, screening of features ------------------------------------------------

PENALTIES = [0.0, 0.02, 0.1, 0.4]
L1_RATIOS = [0.0, 0.5, 1.0]


@query
def elastic_net_path(spark: SparkSession, sf: str) -> DataFrame:
    panel = market.model_panel(spark, sf)
    path = penalized.elastic_net(panel, MODEL_FEATURES, PENALTIES, L1_RATIOS, by=["series_id"])
    return rounded(path.select("series_id", "l1_ratio", "penalty", "term", "coefficient", "n", "r2"), 4)


def _fold_scores(spark: SparkSession, sf: str, features: list[str]) -> DataFrame:
    folded = ordered.series_folds(cut(market.model_panel(spark, sf)), 5)
    return penalized.cross_validate(folded, features, PENALTIES, L1_RATIOS, by=["series_id"])


@query
def ridge_fold_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out scores of one regressor at every penalty, all from one pass over the rows."""
    return rounded(_fold_scores(spark, sf, ["x_qty"]).withColumn("mse", F.round("mse", 2)))


@query
def elastic_net_search(spark: SparkSession, sf: str) -> DataFrame:
    """Exhaustive search over penalties and ratios: each segment's best point, refitted on all its rows."""
    best = cut(penalized.grid_search(_fold_scores(spark, sf, MODEL_FEATURES), ["series_id"]))
    path = penalized.elastic_net(
        market.model_panel(spark, sf), MODEL_FEATURES, PENALTIES, L1_RATIOS, by=["series_id"]
    )
    found = penalized.refit_best(path, best, ["series_id"])
    return rounded(found.select("series_id", "l1_ratio", "penalty", "mean_r2", "term", "coefficient"), 4)


@query
def feature_f_tests(spark: SparkSession, sf: str) -> DataFrame:
    panel = market.model_panel(spark, sf).withColumn("x_flat", F.lit(1.0))
    return rounded(screening.f_regression(panel, [*MODEL_FEATURES, "x_flat"], by=["series_id"]), 6)


@query
def k_best_features(spark: SparkSession, sf: str) -> DataFrame:
    panel = market.model_panel(spark, sf, fine=True)
    best = screening.select_k_best(panel, MODEL_FEATURES, 1, ["series_id", "ds"])
    name = best.columns[-1]
    return rounded(best.select("series_id", "ds", F.lit(name).alias("best_feature"), F.col(name).alias("best_value")))


@query
def inflation_factors(spark: SparkSession, sf: str) -> DataFrame:
    panel = market.model_panel(spark, sf, fine=True)
    return rounded(screening.inflation_factors(panel, ["y", "x_qty", "x_price"]), 4)


@query
def shared_information(spark: SparkSession, sf: str) -> DataFrame:
    """Information that eight equal bins of each feature share with eight equal bins of the target."""
    panel = market.model_panel(spark, sf, fine=True)
    return rounded(screening.mutual_information(panel, MODEL_FEATURES, bins=8), 6)


@query
def event_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact quantiles of the raw events' values: five groups hold all rows."""
    found = quantiles.exact_quantiles(
        market.event_rows(spark, sf), "value", [0.01, 0.25, 0.5, 0.75, 0.99], ["series_id"], settle=1000
    )
    return rounded(found)


# --- tree ensembles ------------------------------------------------------------------------------

SMALL_GBT = {"maxIter": 100, "maxDepth": 3, "stepSize": 0.2}
ALT_GBT = {"maxIter": 100, "maxDepth": 4, "minInstancesPerNode": 3, "subsamplingRate": 0.8}
SMALL_FOREST = {"numTrees": 100, "maxDepth": 5}


def _tree_panel(spark: SparkSession, sf: str) -> DataFrame:
    panel = market.model_panel(spark, sf, fine=True)
    return stats.minmax_scale(panel, MODEL_FEATURES)


def _tree_predictions(spark: SparkSession, sf: str, estimator) -> DataFrame:
    scored = trees.fit_predict(
        _tree_panel(spark, sf), MODEL_FEATURES, estimator, ["series_id", "ds", "y"]
    )
    return rounded(scored)


@query
def gbt_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return _tree_predictions(spark, sf, trees.gbt(**SMALL_GBT))


@query
def gbt_alt_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return _tree_predictions(spark, sf, trees.gbt(seed=24, **ALT_GBT))


@query
def forest_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return _tree_predictions(spark, sf, trees.forest(**SMALL_FOREST))


def _ensembles() -> dict[str, Estimator]:
    return {
        "gbt": trees.gbt(**SMALL_GBT),
        "gbt_alt": trees.gbt(seed=24, **ALT_GBT),
        "forest": trees.forest(**SMALL_FOREST),
    }


def _importances(spark: SparkSession, sf: str) -> DataFrame:
    table, names = trees.prepare(_tree_panel(spark, sf), MODEL_FEATURES)
    table = trees.laid_out(table)
    return metrics.union_trials(
        [
            trees.importance_frame(table, estimator.fit(table), names, label)
            for label, estimator in _ensembles().items()
        ]
    )


@query
def importance_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_importances(spark, sf), 6)


@query
def importance_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(trees.rank_importance(_importances(spark, sf), 3), 6)


@query
def project_topk_features(spark: SparkSession, sf: str) -> DataFrame:
    table, names = trees.prepare(_tree_panel(spark, sf), MODEL_FEATURES)
    table = trees.laid_out(table)
    ranking = trees.importance_frame(
        table, trees.forest(**SMALL_FOREST).fit(table), names, "forest"
    )
    return rounded(shape.select_ranked(table, ranking, 2, ["series_id", "ds"]), 6)


@query
def random_search_trials(spark: SparkSession, sf: str) -> DataFrame:
    trials, _ = trees.random_search(
        market.model_panel(spark, sf, fine=True),
        MODEL_FEATURES,
        trees.gbt(maxIter=10),
        {"maxDepth": [2, 3, 4], "stepSize": [0.05, 0.1, 0.2], "subsamplingRate": [0.5, 1.0]},
        n_iter=10,
        folds=5,
    )
    return rounded(trials, 6)


@query
def random_search_alt_trials(spark: SparkSession, sf: str) -> DataFrame:
    """The second booster's draws: shallow steps, node sizes in place of numbers of leaves."""
    trials, _ = trees.random_search(
        market.model_panel(spark, sf, fine=True),
        MODEL_FEATURES,
        trees.gbt(seed=24, maxIter=10),
        {"maxDepth": [3, 5], "stepSize": [0.02, 0.06, 0.15], "minInstancesPerNode": [1, 5, 20], "subsamplingRate": [0.7, 1.0]},
        n_iter=10,
        folds=5,
        seed=24,
    )
    return rounded(trials, 6)


@query
def random_search_forest_trials(spark: SparkSession, sf: str) -> DataFrame:
    trials, _ = trees.random_search(
        market.model_panel(spark, sf, fine=True),
        MODEL_FEATURES,
        trees.forest(numTrees=20),
        {"maxDepth": [2, 5, 10], "minInstancesPerNode": [1, 4, 8], "featureSubsetStrategy": ["all", "sqrt"]},
        n_iter=10,
        folds=5,
    )
    return rounded(trials, 6)


@query
def refit_topk_score(spark: SparkSession, sf: str) -> DataFrame:
    """All three models: ranked on the training rows, refitted on the two best features, scored on both parts."""
    panel = market.model_panel(spark, sf, fine=True)
    return rounded(trees.rank_refit_scores(panel, MODEL_FEATURES, _ensembles(), 2, ["series_id", "ds"]), 6)


@query
def model_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Search, training score and holdout of all three models on the same split."""
    panel = cut(market.model_panel(spark, sf, fine=True))
    searches = {
        "gbt": (trees.gbt(maxIter=10), {"maxDepth": [2, 4], "stepSize": [0.1, 0.3]}),
        "gbt_alt": (trees.gbt(seed=24, maxIter=10), {"minInstancesPerNode": [1, 10], "stepSize": [0.05, 0.15]}),
        "forest": (trees.forest(numTrees=20), {"maxDepth": [3, 8], "minInstancesPerNode": [1, 4]}),
    }
    reports = [
        trees.search_report(panel, MODEL_FEATURES, estimator, points, 2, label, n_iter=3, folds=3)
        for label, (estimator, points) in searches.items()
    ]
    return rounded(metrics.union_trials(reports), 6)


# Trees over features of few whole values: every candidate split is exact, so SQL grows the same.

STUMP_FEATURES = ["x_month", "x_price_k", "x_year"]
WHOLE_TREE = {"numTrees": 1, "maxDepth": 2, "bootstrap": False, "featureSubsetStrategy": "all"}


def _stump_panel(spark: SparkSession, sf: str) -> DataFrame:
    panel = market.model_panel(spark, sf, fine=True)
    return panel.select(
        "series_id",
        "ds",
        "y",
        F.month("ds").cast("double").alias("x_month"),
        F.floor(F.coalesce("x_price", F.lit(0.0)) / 2000).cast("double").alias("x_price_k"),
        F.year("ds").cast("double").alias("x_year"),
    )


def _stump_predictions(spark: SparkSession, sf: str, estimator) -> DataFrame:
    keep = ["series_id", "ds", "y"]
    return rounded(trees.fit_predict(_stump_panel(spark, sf), STUMP_FEATURES, estimator, keep))


@query
def tree_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return _stump_predictions(spark, sf, trees.forest(**WHOLE_TREE))


@query
def gbt_two_rounds(spark: SparkSession, sf: str) -> DataFrame:
    return _stump_predictions(spark, sf, trees.gbt(maxIter=2, maxDepth=1, stepSize=0.2))


@query
def gbt_alt_one_round(spark: SparkSession, sf: str) -> DataFrame:
    return _stump_predictions(spark, sf, trees.gbt(maxIter=1, maxDepth=1, minInstancesPerNode=60))


def _stump_importance(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    table, names = trees.prepare(_stump_panel(spark, sf), STUMP_FEATURES)
    table = cut(table)
    model = trees.forest(**WHOLE_TREE).fit(table)
    return table, trees.importance_frame(table, model, names, "forest")


@query
def tree_importance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_stump_importance(spark, sf)[1], 6)


@query
def tree_importance_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(trees.rank_importance(_stump_importance(spark, sf)[1], 2), 6)


@query
def tree_topk_projection(spark: SparkSession, sf: str) -> DataFrame:
    table, ranking = _stump_importance(spark, sf)
    best = shape.select_ranked(table, ranking, 1, ["series_id", "ds"])
    name = best.columns[-1]
    return best.select("series_id", "ds", F.lit(name).alias("best_feature"), F.col(name).alias("best_value"))


@query
def tree_refit_score(spark: SparkSession, sf: str) -> DataFrame:
    panel, key = _stump_panel(spark, sf), ["series_id", "ds"]
    estimator = trees.forest(**WHOLE_TREE)
    scores = trees.rank_refit_score(panel, STUMP_FEATURES, estimator, 1, key, "forest")
    best = F.get("features_used", F.lit(0)).alias("best_feature")
    return rounded(scores.select("model", "split", "n", "r2", "mae", best), 6)


@query
def tree_search_trials(spark: SparkSession, sf: str) -> DataFrame:
    estimator = trees.forest(**WHOLE_TREE)
    trials, _ = trees.random_search(
        _stump_panel(spark, sf), STUMP_FEATURES, estimator, {"maxDepth": [1, 2]}, n_iter=2, folds=3
    )
    depth = F.col("params").getItem("maxDepth").alias("max_depth")
    return rounded(trials.select("trial_id", depth, "mean_score"), 6)


# --- attribution ---------------------------------------------------------------------------------


@query
def shapley_values(spark: SparkSession, sf: str) -> DataFrame:
    table, names = trees.prepare(_tree_panel(spark, sf), MODEL_FEATURES)
    table = trees.laid_out(table)
    model = trees.gbt(**SMALL_GBT).fit(table)
    key = ["series_id", "ds"]
    return rounded(attribution.shapley(model, table, table, names, key), 6)


@query
def shapley_linear(spark: SparkSession, sf: str) -> DataFrame:
    """The same attribution of a linear model, whose shares have a closed form."""
    table, names = trees.prepare(_tree_panel(spark, sf), MODEL_FEATURES)
    table = trees.laid_out(table)
    model = LinearRegression(labelCol="y").fit(table)
    key = ["series_id", "ds"]
    phi = attribution.shapley(model, table, table, names, key)
    return phi.withColumns({"value": F.round("value", 9), "phi": F.round("phi", 4)})


@query
def shapley_tree(spark: SparkSession, sf: str) -> DataFrame:
    """The same attribution of a one-split tree: the split feature carries all of it."""
    table, names = trees.prepare(_stump_panel(spark, sf), STUMP_FEATURES)
    table = cut(table)
    model = trees.forest(**{**WHOLE_TREE, "maxDepth": 1}).fit(table)
    key = ["series_id", "ds"]
    phi = attribution.shapley(model, table, table, names, key)
    # adding zero drops the sign of a negative zero
    return phi.withColumn("phi", F.round("phi", 4) + F.lit(0.0))


@query
def shap_importance(spark: SparkSession, sf: str) -> DataFrame:
    phi = market.linear_phi(market.model_panel(spark, sf, fine=True))
    return rounded(attribution.shap_importance(phi), 4)


@query
def row_decomposition(spark: SparkSession, sf: str) -> DataFrame:
    phi = market.linear_phi(market.model_panel(spark, sf, fine=True))
    return attribution.decompose_rows(phi, 3)


@query
def phi_distribution(spark: SparkSession, sf: str) -> DataFrame:
    phi = market.linear_phi(market.model_panel(spark, sf, fine=True))
    spread = attribution.phi_distribution(phi)
    # The mean is zero but for rounding; adding zero drops the sign of a negative zero.
    return spread.withColumn("mean_phi", F.round("mean_phi", 4) + F.lit(0.0))


@query
def phi_dependence(spark: SparkSession, sf: str) -> DataFrame:
    phi = market.linear_phi(market.model_panel(spark, sf, fine=True))
    return rounded(attribution.phi_dependence(phi, MODEL_FEATURES, 10), 4)
