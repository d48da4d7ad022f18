from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import ordered, penalized
from tests.helpers import least_squares, months

FEATURES = ["a", "b", "c d", "flat"]


def data(seed, n=90):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 3)) * [1.0, 50.0, 0.01] + [1e3, 5.0, 0.0]
    x[:, 1] += 30 * (x[:, 0] - 1e3)  # correlated
    y = 2.0 * x[:, 0] - 0.1 * x[:, 1] + rng.normal(0, 1, n)
    return np.column_stack([x, np.full(n, 7.0)]), y


def frame(spark, groups):
    rows = []
    for name, (x, y) in groups.items():
        rows += [(name, d, float(v), *map(float, r)) for d, r, v in zip(months(len(y)), x, y)]
    return spark.createDataFrame(rows, "g string, ds date, y double, a double, b double, `c d` double, flat double")


def objective(x, y, const, coef, ratio, penalty):
    sx, sy = x.std(axis=0), y.std()
    beta = coef * sx / sy
    rest = (y - const - x @ coef) / sy
    return rest @ rest / (2 * len(y)) + penalty * (ratio * np.abs(beta).sum() + (1 - ratio) * beta @ beta / 2)


def paths(df, **options):
    found = {}
    for r in penalized.elastic_net(df, FEATURES, by=["g"], **options).collect():
        found.setdefault((r["g"], r["l1_ratio"], r["penalty"]), {})[r["term"]] = r
    return found


def test_optimality_of_the_whole_path(spark):
    groups = {"p": data(1), "q": data(2, 40)}
    found = paths(frame(spark, groups), penalties=(0.0, 0.01, 0.1, 0.5, 2.0), l1_ratios=(0.0, 0.4, 1.0))
    assert len(found) == 2 * 15
    rng = np.random.default_rng(3)
    for (g, ratio, penalty), terms in found.items():
        x, y = groups[g]
        const = terms["const"]["coefficient"]
        coef = np.array([terms[c]["coefficient"] for c in FEATURES])
        assert coef[3] == 0 and terms["a"]["gap"] < 1e-9 and terms["a"]["settled"]
        np.testing.assert_allclose(const, y.mean() - x.mean(axis=0) @ coef, rtol=1e-6, atol=1e-6)
        here = objective(x, y, const, coef, ratio, penalty)
        for _ in range(40):  # no small step makes it better
            step = coef + rng.normal(0, 1e-3, 4) * y.std() / np.maximum(x.std(axis=0), 1e-12) * [1, 1, 1, 0]
            assert objective(x, y, y.mean() - x.mean(axis=0) @ step, step, ratio, penalty) >= here - 1e-12
        if penalty == 0:
            beta, _, sse = least_squares(np.column_stack([np.ones(len(y)), x[:, :3]]), y)
            np.testing.assert_allclose([const, *coef[:3]], beta, rtol=1e-5, atol=1e-5)
            np.testing.assert_allclose(terms["a"]["r2"], 1 - sse / ((y - y.mean()) ** 2).sum(), rtol=1e-8)
        if ratio == 1 and penalty == 2.0:
            assert (coef == 0).all()


def test_lasso_drops_columns_and_one_column_has_a_closed_form(spark):
    x, y = data(4)
    df = frame(spark, {"p": (x, y)})
    sparse = paths(df, penalties=(0.2,))["p", 1.0, 0.2]
    assert sparse["c d"]["coefficient"] == 0 and sparse["a"]["coefficient"] != 0
    r = np.corrcoef(x[:, 0], y)[0, 1]
    for ratio, penalty in ((1.0, 0.3), (0.5, 0.2), (0.0, 0.7)):
        one = penalized.elastic_net(df, ["a"], [penalty], [ratio]).filter("term = 'a'").first()
        want = np.sign(r) * max(abs(r) - penalty * ratio, 0) / (1 + penalty * (1 - ratio)) * y.std() / x[:, 0].std()
        np.testing.assert_allclose(one["coefficient"], want, rtol=1e-9)


def test_fold_scores_equal_explicit_refits(spark):
    groups = {"p": data(5), "q": data(6, 33)}
    folded = ordered.series_folds(frame(spark, groups), 4, by=["g"])
    scores = penalized.cross_validate(folded, FEATURES[:3], (0.0, 0.05), (0.0, 1.0), by=["g"])
    got = {(r["g"], r["l1_ratio"], r["penalty"], r["fold"]): r for r in scores.collect()}
    assert len(got) == 2 * 4 * 4
    for g, (x, y) in groups.items():
        x = x[:, :3]
        for fold, test in enumerate(np.array_split(np.arange(len(y)), 4), 1):
            train = np.setdiff1d(np.arange(len(y)), test)
            own = frame(spark, {g: (np.column_stack([x, x[:, 0] * 0])[train], y[train])})
            for ratio, penalty in ((0.0, 0.0), (1.0, 0.05)):
                fit = {r["term"]: r["coefficient"] for r in penalized.elastic_net(own, FEATURES[:3], [penalty], [ratio]).collect()}
                rest = y[test] - fit["const"] - x[test] @ [fit[c] for c in FEATURES[:3]]
                row = got[g, ratio, penalty, fold]
                assert row["n"] == len(test)
                np.testing.assert_allclose(row["mse"], rest @ rest / len(test), rtol=1e-6)
                np.testing.assert_allclose(row["r2"], 1 - rest @ rest / ((y[test] - y[test].mean()) ** 2).sum(), rtol=1e-6, atol=1e-7)
    best = {r["g"]: r for r in penalized.grid_search(scores, ["g"]).collect()}
    for g in groups:
        means = {}
        for (h, ratio, penalty, _), r in got.items():
            if h == g:
                means.setdefault((ratio, penalty), []).append(r["r2"])
        want = max(means, key=lambda k: np.mean(means[k]))
        assert (best[g]["l1_ratio"], best[g]["penalty"]) == want
    refit = penalized.refit_best(
        penalized.elastic_net(folded, FEATURES[:3], (0.0, 0.05), (0.0, 1.0), by=["g"]), penalized.grid_search(scores, ["g"]), ["g"]
    )
    assert refit.count() == 2 * 4


def test_missing_rows_constant_targets_and_empty_tables(spark):
    x, y = data(7, 30)
    df = frame(spark, {"p": (x, y), "level": (x, np.full(30, 3.0))})
    holes = df.withColumn("a", F.when(F.month("ds") == 3, F.lit(float("nan"))).otherwise(F.col("a")))
    full = df.filter(F.month("ds") != 3)
    some = [r["coefficient"] for r in penalized.elastic_net(holes, FEATURES, [0.1], by=["g"]).orderBy("g", "term").collect()]
    want = [r["coefficient"] for r in penalized.elastic_net(full, FEATURES, [0.1], by=["g"]).orderBy("g", "term").collect()]
    np.testing.assert_allclose(some, want, rtol=1e-7, atol=1e-9)
    level = penalized.elastic_net(df, FEATURES, [0.1], by=["g"]).filter("g = 'level'").collect()
    assert {r["term"]: round(r["coefficient"], 9) for r in level} == {"const": 3.0, **{c: 0.0 for c in FEATURES}}
    assert all(r["r2"] is None for r in level)
    assert penalized.elastic_net(df.filter(F.lit(False)), FEATURES, by=["g"]).count() == 0
    one = df.withColumn("fold", F.lit(1))
    assert penalized.cross_validate(one, FEATURES, by=["g"]).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_descent_meets_its_conditions(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))
    xx = np.corrcoef(x.T)[None].repeat(4, axis=0)
    xy = xx[:, 0] * 0.5 + xx[:, 2] * 0.3
    lasso, ridge = np.array([0.0, 0.1, 0.0, 0.3]), np.array([0.0, 0.0, 0.5, 0.2])
    beta, done = penalized.descend(xx, xy, lasso, ridge)
    assert done.all() and penalized.violation(xx, xy, beta, lasso, ridge).max() < 1e-9
