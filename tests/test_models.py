from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.functions import normal_cdf
from panelcast.operators import gram, ordered, sarx, search, stationarity, trend_season
from panelcast.operators.lineage import cut
from tests.helpers import least_squares, months, panel, rows_of, seasonal_series


def test_normal_cdf(spark):
    df = spark.createDataFrame([(z,) for z in (-3.0, -0.5, 0.0, 1.2, 4.0)], "z double")
    for z, p in df.select("z", normal_cdf(F.col("z"))).collect():
        assert p == pytest.approx(0.5 * (1 + math.erf(z / math.sqrt(2))), abs=2e-7)


# --- least squares -------------------------------------------------------------------------------


@pytest.fixture
def design(spark):
    rng = np.random.default_rng(3)
    data = {g: rng.normal(size=(n, 4)) for g, n in (("a", 50), ("b", 12))}
    rows = [(g, *map(float, r), float(r @ [1, 2, 0, -1] + 0.3)) for g, x in data.items() for r in x]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double, d double, y double")
    return df, data


def test_gram_solution_equals_least_squares(spark, design, monkeypatch):
    df, data = design
    noisy = df.withColumn("y", F.col("y") + F.sin(F.col("a") * 50))
    terms = [F.lit(1.0), *[F.col(c) for c in "abcd"], F.col("y")]
    fits = {}
    for limit in (40, 2):  # native sums, then the wide path
        monkeypatch.setattr(gram, "NATIVE_COLUMNS", limit)
        sums = gram.gram(noisy, ["g"], terms, [F.max("a").alias("top")])
        fitted = sums.select("g", "top", gram.ols(6)("n", "gram").alias("f"))
        fits[limit] = {r["g"]: r for r in fitted.collect()}
    for g, x in data.items():
        full = np.column_stack([np.ones(len(x)), x])
        y = x @ [1, 2, 0, -1] + 0.3 + np.sin(x[:, 0] * 50)
        beta, se, sse = least_squares(full, y)
        for fit in fits.values():
            f = fit[g]["f"]
            np.testing.assert_allclose(f["beta"], beta, atol=1e-9)
            np.testing.assert_allclose(f["se"], se, rtol=1e-8)
            assert f["sse"] == pytest.approx(sse) and f["n"] == len(x)
            assert fit[g]["top"] == pytest.approx(x[:, 0].max())


def test_singular_design_gets_a_solution(spark, design):
    df, _ = design
    terms = [F.lit(1.0), F.col("a"), F.col("a") * 2, F.col("y")]
    fit = gram.gram(df, ["g"], terms).select(gram.ols(4)("n", "gram").alias("f")).first()["f"]
    assert fit["k"] == 2 and np.isfinite(fit["beta"]).all()


def test_wide_path_adds_partial_sums_over_tasks(spark, design, monkeypatch):
    df, _ = design
    terms = [F.lit(1.0), F.col("a"), F.col("y")]
    native = {r["g"]: r["gram"] for r in gram.gram(df, ["g"], terms).collect()}
    monkeypatch.setattr(gram, "NATIVE_COLUMNS", 1)
    wide = {r["g"]: r["gram"] for r in gram.gram(df.repartition(5), ["g"], terms).collect()}
    for g in native:
        np.testing.assert_allclose(native[g], wide[g], atol=1e-9)


# --- stationarity --------------------------------------------------------------------------------


def reference_adf(y: np.ndarray, regression: str, fixed_lag: int | None):
    """Textbook augmented test by direct regressions."""
    extra = 1 if regression == "c" else 2
    n = len(y)
    dy = np.diff(y)

    def design(lag: int, start: int):
        rows = np.arange(start, len(dy))
        columns = [np.ones(len(rows))]
        if extra == 2:
            columns.append(rows.astype(float))
        columns.append(y[rows])
        columns += [dy[rows - i] for i in range(1, lag + 1)]
        return np.column_stack(columns), dy[rows]

    top = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - extra - 1)
    if fixed_lag is None:
        scores = []
        for lag in range(top + 1):
            x, target = design(lag, top)
            _, _, sse = least_squares(x, target)
            scores.append(len(target) * math.log(sse / len(target)) + 2 * x.shape[1])
        fixed_lag = int(np.argmin(scores))
    x, target = design(fixed_lag, fixed_lag)
    beta, se, _ = least_squares(x, target)
    return beta[extra] / se[extra], fixed_lag, len(target)


@pytest.fixture(scope="module")
def walks(spark):
    rng = np.random.default_rng(7)
    series = {f"walk{i}": np.cumsum(rng.normal(size=90 + i)) for i in range(4)}
    ar = np.zeros(120)
    for t in range(1, 120):
        ar[t] = 0.3 * ar[t - 1] + rng.normal()
    series["ar"] = ar + 1e6
    series["seasonal"] = seasonal_series(60, 2)
    return panel(spark, series), series


def test_adf_equals_direct_regressions(walks):
    df, series = walks
    got = {r["series_id"]: r for r in stationarity.adf_test(df).collect()}
    for name, y in series.items():
        stat, lag, n = reference_adf(y, "c", None)
        assert got[name]["statistic"] == pytest.approx(stat, rel=1e-6)
        assert (got[name]["used_lag"], got[name]["n_obs"]) == (lag, n)
    assert got["ar"]["stationary"] and not got["walk0"]["stationary"]


def test_should_diff_uses_trend_and_cube_root_lag(walks):
    df, series = walks
    got = {r["series_id"]: r for r in stationarity.should_diff(df).collect()}
    for name, y in series.items():
        stat, _, _ = reference_adf(y, "ct", int((len(y) - 1) ** (1 / 3) + 1e-9))
        assert got[name]["statistic"] == pytest.approx(stat, rel=1e-6)
    assert got["walk1"]["diff"] and not got["ar"]["diff"]


def test_adf_on_timestamps_equals_dates(spark, walks):
    df, _ = walks
    hourly = df.withColumn(
        "ds", (F.col("ds").cast("timestamp")).cast("timestamp_ntz")
    )
    dates = {r["series_id"]: r["statistic"] for r in stationarity.adf_test(df).collect()}
    for r in stationarity.adf_test(hourly).collect():
        assert r["statistic"] == pytest.approx(dates[r["series_id"]], rel=1e-9)


def test_constant_and_short_series_have_no_statistic(spark):
    df = panel(spark, {"flat": np.ones(30), "short": np.arange(3.0), "ok": np.arange(30.0) ** 1.5})
    got = {r["series_id"]: r["statistic"] for r in stationarity.adf_test(df).collect()}
    assert got["flat"] is None and got["short"] is None and got["ok"] is not None


def test_p_values_at_textbook_points(spark):
    df = spark.createDataFrame([(-3.43,), (-2.86,), (-2.57,), (3.0,), (-20.0,)], "s double")
    p = [r[0] for r in df.select(stationarity.unit_root_p_value(F.col("s"))).collect()]
    assert p == [
        pytest.approx(0.01, abs=5e-4),
        pytest.approx(0.05, abs=5e-4),
        pytest.approx(0.10, abs=2e-3),
        1.0,
        0.0,
    ]


def test_closed_form_equals_lag_zero(walks):
    df, _ = walks
    a = {r["series_id"]: r["statistic"] for r in stationarity.df_test(df).collect()}
    for r in stationarity.adf_test(df, max_lag=0).collect():
        assert a[r["series_id"]] == pytest.approx(r["statistic"], rel=1e-7)


# --- seasonal autoregression ---------------------------------------------------------------------


def twin_fit(y, x, orders, seasonal):
    """The same estimator with plain arrays: returns the design rows and the AIC of each order."""
    m, h = orders.m, orders.long_ar

    def diff(v):
        out = np.full(len(v), np.nan)
        out[1:] = v[1:] - v[:-1]
        if seasonal:
            full = np.full(len(v), np.nan)
            full[m + 1 :] = v[m + 1 :] - v[m:-1] - v[1:-m] + v[: -m - 1]
            return full
        return out

    def lag(v, i):
        return np.concatenate([np.full(i, np.nan), v[:-i]])

    z = diff(y / y.std())
    xs = [diff(v / v.std()) for v in x]
    first = np.column_stack([np.ones(len(z)), *[lag(z, i) for i in range(1, h + 1)], *xs])
    ok = ~np.isnan(np.column_stack([first, z])).any(axis=1)
    beta, _, _ = least_squares(first[ok], z[ok])
    e = z - first @ beta
    full = np.column_stack(
        [
            np.ones(len(z)),
            *[lag(z, i) for i in orders.y_lags],
            *[lag(e, i) for i in orders.e_lags],
            *xs,
        ]
    )
    ok = ~np.isnan(np.column_stack([full, z, e])).any(axis=1)
    scores = {}
    for order, columns in orders.candidates(["x"] * len(x)):
        _, _, sse = least_squares(full[ok][:, columns], z[ok])
        scores[order] = ok.sum() * math.log(sse / ok.sum()) + 2 * len(columns)
    return scores


@pytest.fixture(scope="module")
def driven(spark):
    rng = np.random.default_rng(11)
    n = 72
    series, driver = {}, {}
    for j in range(3):
        x = np.cumsum(rng.normal(size=n)) + 50
        season = 5 * np.sin(2 * np.pi * np.arange(n) / 12) if j == 1 else 0
        driver[f"s{j}"] = x
        series[f"s{j}"] = 100 + 2 * x + season + np.cumsum(rng.normal(0, 0.5, n))
    return panel(spark, series, x_1=driver), series, driver


ORDERS = sarx.Orders(m=12, max_p=2, max_q=1, history=48, long_ar=4)


def test_order_search_equals_plain_arrays(driven):
    df, series, driver = driven
    model = cut(sarx.fit_sarx(df, ["x_1"], ORDERS, keep_log=True))
    seasonal = {r["series_id"]: r["seasonal_d"] for r in model.collect()}
    assert seasonal == {"s0": 0, "s1": 1, "s2": 0}
    log = sarx.order_search_log(model).toPandas()
    for name in series:
        want = twin_fit(series[name], [driver[name]], ORDERS, bool(seasonal[name]))
        got = {
            (r.p, r.q, r.seasonal_p, r.seasonal_q): r.aic
            for r in log[log.series_id == name].itertuples()
        }
        assert got.keys() == want.keys()
        for order, aic in want.items():
            assert got[order] == pytest.approx(aic, abs=1e-5)
        best = model.filter(F.col("series_id") == name).first()
        chosen = (best["p"], best["q"], best["seasonal_p"], best["seasonal_q"])
        assert want[chosen] == pytest.approx(min(want.values()), abs=1e-5)


def test_coefficients_recover_driver_effect(driven):
    df, _, _ = driven
    model = sarx.fit_sarx(df, ["x_1"], ORDERS)
    table = sarx.coef_table(model, ["x_1"], ORDERS).filter("term = 'x_1'")
    for row in table.collect():
        assert row["coefficient"] == pytest.approx(2.0, abs=0.35)
        assert row["t_value"] > 5


def test_ar2_is_recovered(spark):
    rng = np.random.default_rng(5)
    z = np.zeros(600)
    for t in range(2, 600):
        z[t] = 0.5 * z[t - 1] - 0.4 * z[t - 2] + rng.normal()
    df = panel(spark, {"a": 100 + np.cumsum(z)})
    orders = sarx.Orders(m=1, max_p=4, max_q=0, history=600)
    model = cut(sarx.fit_sarx(df, [], orders))
    assert model.first()["p"] >= 2
    found = {r["term"]: r["coefficient"] for r in sarx.coef_table(model, [], orders).collect()}
    assert found["ar_1"] == pytest.approx(0.5, abs=0.1)
    assert found["ar_2"] == pytest.approx(-0.4, abs=0.1)


def test_forecast_equals_a_plain_loop(spark, driven):
    df, series, driver = driven
    split = ordered.time_split(df, horizon=12)
    train = split.filter("split = 'train'").drop("split")
    test = split.filter("split = 'test'").drop("split")
    model = cut(sarx.fit_sarx(train, ["x_1"], ORDERS))
    got = sarx.forecast_sarx(model, train, test, ["x_1"], ORDERS).toPandas()
    h = ORDERS.long_ar
    for row in model.collect():
        name, m, seasonal = row["series_id"], 12, bool(row["seasonal_d"])
        y = list(series[name][:-12] / row["y_scale"])
        x = driver[name] / row["x_scale"][0]

        def diff(v, t):
            d = v[t] - v[t - 1]
            return d - (v[t - m] - v[t - m - 1]) if seasonal else d

        start = m + 1 if seasonal else 1
        z = {t: diff(y, t) for t in range(start, len(y))}
        e = {}
        for t in range(start + h, len(y)):
            terms = [1.0, *[z[t - i] for i in range(1, h + 1)], diff(x, t)]
            e[t] = z[t] - float(np.dot(row["ar_beta"], terms))
        want = []
        for t in range(len(y), len(y) + 12):
            terms = [
                1.0,
                *[z[t - i] for i in ORDERS.y_lags],
                *[e.get(t - i, 0.0) for i in ORDERS.e_lags],
                diff(x, t),
            ]
            z[t] = float(np.dot(row["beta"], terms))
            level = z[t] + y[t - 1]
            if seasonal:
                level += y[t - m] - y[t - m - 1]
            y.append(level)
            want.append(level * row["y_scale"])
        mine = got[got.series_id == name].sort_values("ds")
        np.testing.assert_allclose(mine["yhat"], want, rtol=1e-9)
        assert mine["ds"].tolist() == months(72)[-12:]
        truth = series[name][-12:]
        assert np.abs(mine["yhat"] - truth).mean() < np.abs(truth - series[name][-13]).mean() * 1.5


def test_lags_are_capped_by_history():
    orders = sarx.Orders(m=12, history=48)
    assert (orders.P, orders.Q) == (1, 1)
    assert max(orders.y_lags + orders.e_lags) <= 16
    wide = sarx.Orders(m=12, history=400)
    assert (wide.p, wide.q, wide.P, wide.Q) == (5, 5, 5, 5)
    assert len(wide.candidates([])) == math.comb(9, 4)


# --- trend and seasonality -----------------------------------------------------------------------


def trial(mode="additive", n=8, tau=0.5):
    return {"seasonality_mode": mode, "n_changepoints": n, "changepoint_prior_scale": tau}


def test_additive_model_recovers_breaks_season_and_driver(spark):
    rng = np.random.default_rng(9)
    n = 96
    t = np.arange(n)
    x = rng.normal(size=n)
    trend = 50 + 0.5 * t + np.where(t > 30, 1.0 * (t - 30), 0) - np.where(t > 60, 1.2 * (t - 60), 0)
    y = trend + 4 * np.sin(2 * np.pi * t / 12) + 3 * x + rng.normal(0, 0.2, n)
    df = panel(spark, {"a": y}, x_1={"a": x})
    split = cut(ordered.time_split(df, horizon=12))
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    model = trend_season.fit_trend_season(train, [trial(n=12)], ["x_1"], fourier_order=3)
    out = trend_season.predict_trend_season(model, test, ["x_1"], fourier_order=3, keep=["y"])
    pdf = out.toPandas()
    assert (pdf.yhat - pdf.y).abs().mean() < 3.0
    assert (pdf.yhat_lower < pdf.yhat).all() and (pdf.yhat < pdf.yhat_upper).all()
    inside = trend_season.predict_trend_season(
        model, train, ["x_1"], fourier_order=3, interval_width=0.8, keep=["y"]
    ).toPandas()
    cover = ((inside.y > inside.yhat_lower) & (inside.y < inside.yhat_upper)).mean()
    assert 0.65 < cover < 0.95


def test_multiplicative_season_grows_with_trend(spark):
    rng = np.random.default_rng(4)
    t = np.arange(84)
    y = (20 + 1.0 * t) * (1 + 0.3 * np.sin(2 * np.pi * t / 12)) + rng.normal(0, 0.3, 84)
    split = cut(ordered.time_split(panel(spark, {"a": y}), horizon=12))
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    errors = {}
    for mode in ("additive", "multiplicative"):
        model = trend_season.fit_trend_season(train, [trial(mode, 4, 0.05)], fourier_order=3)
        out = trend_season.predict_trend_season(model, test, fourier_order=3, keep=["y"]).toPandas()
        errors[mode] = (out.yhat - out.y).abs().mean()
    assert errors["multiplicative"] < 3.0
    assert errors["multiplicative"] < errors["additive"] / 2


def test_ridge_equals_closed_form(spark):
    y = seasonal_series(60, 1)
    df = panel(spark, {"a": y})
    model = trend_season.fit_trend_season(df, [trial(n=5, tau=0.2)], fourier_order=2).first()
    days = np.array([(d - months(1, "1970-01-01")[0]).days for d in months(60)], dtype=float)
    t = (days - days[0]) / (days[-1] - days[0])
    columns = [np.ones(60), t, *[np.maximum(0, t - 0.8 * j / 5) for j in range(1, 6)]]
    for k in (1, 2):
        columns += [f(2 * np.pi * k * days / 365.25) for f in (np.sin, np.cos)]
    x, target = np.column_stack(columns), y / np.abs(y).max()
    prior = np.array([25, 25, *[2 * 0.2**2] * 5, *[100] * 4])
    noise = 0.01
    for _ in range(6):
        beta = np.linalg.solve(x.T @ x + noise * np.diag(1 / prior), x.T @ target)
        noise = max(((target - x @ beta) ** 2).mean(), 1e-8)
    np.testing.assert_allclose(model["beta"], beta, atol=1e-6)
    assert model["sigma"] == pytest.approx(math.sqrt(noise), rel=1e-6)


def test_knots_beyond_history_are_clipped_and_trials_coincide(spark):
    df = panel(spark, {"a": seasonal_series(48, 1), "b": seasonal_series(20, 2)})
    trials = [trial(n=100), trial(n=150), trial(n=200)]
    model = trend_season.fit_trend_season(df, trials, fourier_order=1)
    got = {(r["series_id"], r["trial_id"]): r for r in model.collect()}
    assert {got["a", i]["n_knots"] for i in (1, 2, 3)} == {37}
    assert {got["b", i]["n_knots"] for i in (1, 2, 3)} == {15}
    np.testing.assert_allclose(got["a", 1]["beta"], got["a", 3]["beta"], atol=1e-8)


def test_grid_search_scores_on_validation_and_keeps_test_apart(spark):
    series = {f"s{i}": seasonal_series(72, i) for i in range(3)}
    grid = {
        "seasonality_mode": ["additive", "multiplicative"],
        "n_changepoints": [2, 4],
        "changepoint_prior_scale": [0.05, 0.5],
    }
    split = cut(ordered.three_way_split(panel(spark, series), 12, 12))
    train, validate, test = (split.filter(f"split = '{p}'") for p in ("train", "validate", "test"))
    log = search.forecast_grid_search(train, validate, grid, fourier_order=2).toPandas()
    assert len(log) == 3 * 8 and (log.n == 12).all() and log.mape.between(0, 0.2).all()
    noisy = test.withColumn("y", F.rand(1) * 1e6)
    a = search.best_forecast(train, validate, test, grid, fourier_order=2).toPandas()
    b = search.best_forecast(train, validate, noisy, grid, fourier_order=2).toPandas()
    a, b = (f.sort_values(["series_id", "ds"]).yhat.to_numpy() for f in (a, b))
    np.testing.assert_allclose(a, b)
    truth = np.concatenate([series[s][-12:] for s in sorted(series)])
    assert np.abs(a - truth).mean() < 1.0


def test_timestamp_panels_equal_date_panels(spark, driven):
    df, _, _ = driven
    stamped = df.withColumn("ds", F.col("ds").cast("timestamp_ntz"))
    got = []
    for frame in (df, stamped):
        split = cut(ordered.time_split(frame, horizon=12))
        train, test = (split.filter(f"split = '{p}'").drop("split") for p in ("train", "test"))
        model = cut(sarx.fit_sarx(train, ["x_1"], ORDERS))
        a = sarx.forecast_sarx(model, train, test, ["x_1"], ORDERS)
        trend = trend_season.fit_trend_season(train, [trial("multiplicative")], ["x_1"])
        b = trend_season.predict_trend_season(trend, test, ["x_1"])
        got.append(
            [
                f.select("series_id", "ds", "yhat").toPandas().sort_values(["series_id", "ds"]).yhat
                for f in (a, b)
            ]
        )
    for plain, chunked in zip(*got):
        np.testing.assert_allclose(plain, chunked, rtol=1e-9)


def test_results_do_not_depend_on_layout_or_other_series(spark):
    series = {f"s{i}": seasonal_series(60, i) for i in range(3)}
    full = panel(spark, series).repartition(5)
    alone = panel(spark, {"s1": series["s1"]}).coalesce(1)
    for run in (
        lambda d: stationarity.adf_test(d, max_lag=6).select("series_id", "statistic"),
        lambda d: trend_season.fit_trend_season(d, [trial()]).select("series_id", "sigma"),
        lambda d: sarx.fit_sarx(d, [], ORDERS).select("series_id", "aic"),
    ):
        a = dict(rows_of(run(full), "series_id"))["s1"]
        b = dict(rows_of(run(alone), "series_id"))["s1"]
        assert a == pytest.approx(b, rel=1e-8)
