from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from panelcast.operators import attribution, trees
from panelcast.operators.lineage import cut
from tests.helpers import months, rows_of

FEATURES = ["x_a", "x_b", "x_c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 3))
    y = 5 * x[:, 0] - 2 * x[:, 1] + 0.1 * rng.normal(size=120)
    rows = [
        (f"s{i % 2}", months(60)[i // 2], float(y[i]), *map(float, x[i])) for i in range(120)
    ]
    rows[3] = (*rows[3][:3], None, float("nan"), rows[3][5])
    schema = "series_id string, ds date, y double, x_a double, x_b double, x_c double"
    return spark.createDataFrame(rows, schema)


def test_gaps_are_filled_and_flagged(table):
    prepared, names = trees.prepare(table, FEATURES, flag=True)
    assert names == [*FEATURES, "x_a_missing", "x_b_missing", "x_c_missing"]
    row = prepared.filter("x_a_missing = 1").first()
    assert row["x_b_missing"] == 1 and np.isfinite(row["features"].toArray()).all()


@pytest.mark.parametrize(
    "make", [lambda: trees.gbt(maxIter=10, maxDepth=3), lambda: trees.forest(maxDepth=30)]
)
def test_ensembles_fit_and_rank_the_strong_feature(table, make):
    estimator = make()
    keep = ["series_id", "ds", "y"]
    scored = trees.fit_predict(table, FEATURES, estimator, keep).toPandas()
    residual = ((scored.y - scored.yhat) ** 2).sum() / ((scored.y - scored.y.mean()) ** 2).sum()
    assert len(scored) == 120 and 1 - residual > 0.8
    prepared, names = trees.prepare(table, FEATURES)
    found = trees.importance_frame(table, estimator.fit(prepared), names, "m")
    ranked = trees.rank_importance(found, 2)
    assert [(r[1], r[3]) for r in rows_of(ranked, "rank")] == [("x_a", 1), ("x_b", 2)]


def test_random_search_draws_and_scores(table):
    grid = {"maxDepth": [1, 3], "stepSize": [0.1, 0.3]}
    trials, best = trees.random_search(table, FEATURES, trees.gbt(maxIter=3), grid, 3, 3, seed=1)
    log = trials.orderBy("trial_id").collect()
    assert [r["trial_id"] for r in log] == [1, 2, 3]
    assert all(set(r["params"]) == {"maxDepth", "stepSize"} for r in log)
    top = max(log, key=lambda r: r["mean_score"])
    assert best.getMaxDepth() == int(top["params"]["maxDepth"])


def test_rank_refit_score(table):
    out = trees.rank_refit_score(
        table, FEATURES, trees.forest(numTrees=10), 2, ["series_id", "ds"], "forest"
    ).toPandas().set_index("split")
    assert out.loc["test", "n"] == 24 and out.loc["train", "n"] == 96
    assert list(out.loc["test", "features_used"]) == ["x_a", "x_b"]
    assert out.loc["test", "r2"] > 0.5


@pytest.fixture(scope="module")
def linear(table):
    prepared, _ = trees.prepare(table, FEATURES)
    prepared = cut(prepared)
    return LinearRegression(labelCol="y").fit(prepared), prepared


def test_shapley_of_a_linear_model_is_exact(linear):
    model, prepared = linear
    key = ["series_id", "ds"]
    phi = attribution.shapley(model, prepared, prepared, FEATURES, key, n_background=120)
    pdf = prepared.toPandas()
    means = pdf[FEATURES].mean()
    got = phi.toPandas().merge(pdf, on=key)
    for i, c in enumerate(FEATURES):
        part = got[got.feature == c]
        want = model.coefficients[i] * (part[c] - means[c])
        np.testing.assert_allclose(part.phi, want, atol=1e-9)
        np.testing.assert_allclose(part.value, part[c])


def test_shares_add_up_to_the_prediction(table, linear):
    _, prepared = linear
    key = ["series_id", "ds"]
    model = trees.gbt(maxIter=5, maxDepth=3).fit(prepared)
    phi = attribution.shapley(model, prepared, prepared, FEATURES, key, n_background=120)
    total = phi.groupBy(*key).agg(F.sum("phi").alias("s"))
    scored = model.transform(prepared)
    mean = scored.agg(F.avg("prediction")).first()[0]
    gap = scored.join(total, key).select(
        F.max(F.abs(F.col("prediction") - mean - F.col("s")))
    ).first()[0]
    assert gap < 1e-9


def test_sampled_orders_add_up_and_agree_on_linear_models(spark):
    rng = np.random.default_rng(8)
    names = [f"x_{i:02}" for i in range(12)]
    rows = [(i, *map(float, rng.normal(size=12))) for i in range(30)]
    df = spark.createDataFrame(rows, "row_id int, " + ", ".join(f"{c} double" for c in names))
    df = df.withColumn("y", F.col("x_00") * 3 - F.col("x_05"))
    prepared = cut(trees.prepare(df, names)[0])
    model = LinearRegression(labelCol="y").fit(prepared)
    phi = attribution.shapley(
        model, prepared, prepared, names, ["row_id"], n_background=30, n_perm=2
    )
    pdf = prepared.toPandas().set_index("row_id")
    got = phi.filter("feature = 'x_00'").toPandas().set_index("row_id")
    np.testing.assert_allclose(
        got.phi.sort_index(), 3 * (pdf["x_00"] - pdf["x_00"].mean()).sort_index(), atol=1e-6
    )


@pytest.fixture(scope="module")
def phi(spark):
    rows = [(r, f"f{j}", float(r + j), float((r - 2) * (j + 1))) for r in range(5) for j in range(4)]
    return spark.createDataFrame(rows, "row_id int, feature string, value double, phi double")


def test_rankings_and_decomposition(phi):
    got = rows_of(attribution.shap_importance(phi), "importance")
    assert [f for f, _ in got] == ["f0", "f1", "f2", "f3"]
    assert got[0][1] == pytest.approx(1.2)
    parts = attribution.decompose_rows(phi, 3).filter("row_id = 0")
    assert sorted((r["rank"], r["part"], r["phi"]) for r in parts.collect()) == [
        (1, "f3", -8.0),
        (2, "f2", -6.0),
        (3, "other", -6.0),
    ]
    whole = attribution.decompose_rows(phi, 15).filter("row_id = 0")
    assert {r["part"] for r in whole.collect()} == {"f0", "f1", "f2", "f3"}


def test_distribution_and_dependence(phi):
    row = attribution.phi_distribution(phi).filter("feature = 'f1'").first()
    assert (row["n"], row["min_phi"], row["q50_phi"], row["max_phi"]) == (5, -4.0, 0.0, 4.0)
    bins = attribution.phi_dependence(phi, ["f1"], 2).orderBy("bin").collect()
    assert [(b["bin"], b["n"], b["mean_phi"]) for b in bins] == [(0, 2, -3.0), (1, 3, 2.0)]
    same = phi.withColumn("value", F.lit(1.0))
    assert {r["bin"] for r in attribution.phi_dependence(same).collect()} == {0}


def test_background_is_a_fixed_draw(linear):
    _, prepared = linear
    key = ["series_id", "ds"]

    def drawn(frame):
        value = attribution.background_rows(frame, ["x_a"], key, 7, 1)
        return frame.sparkSession.range(1).select(value.alias("b")).first()["b"]

    assert drawn(prepared.repartition(5)) == drawn(prepared.coalesce(1))
    assert len(drawn(prepared)) == 7


@pytest.mark.parametrize(
    "make",
    [
        lambda: trees.gbt(maxIter=8, maxDepth=3, subsamplingRate=0.6),
        lambda: trees.forest(numTrees=8, maxDepth=4, subsamplingRate=0.7),
    ],
    ids=["gbt", "forest"],
)
def test_predictions_do_not_depend_on_the_layout(table, make):
    keep, estimator = ["series_id", "ds"], make()
    one = rows_of(trees.fit_predict(table.repartition(1), FEATURES, estimator, keep), *keep)
    assert one == rows_of(trees.fit_predict(table.repartition(7, "x_c"), FEATURES, estimator, keep), *keep)
    assert one == rows_of(trees.fit_predict(table.orderBy(F.desc("y")), FEATURES, estimator, keep), *keep)


def test_search_scores_equal_explicit_fits_without_a_leak(spark, table):
    """Every draw and fold again: gaps filled with training means only, scored by plain numpy."""
    late = table.withColumn("x_a", F.when(F.month("ds") % 3 == 0, None).otherwise(F.col("x_a") + F.year("ds")))
    grid = {"maxDepth": [1, 2], "minInstancesPerNode": [1, 9]}
    one_tree = trees.forest(numTrees=1, bootstrap=False, featureSubsetStrategy="all")
    trials, best = trees.random_search(late, FEATURES, one_tree, grid, 4, 3)
    from panelcast.operators.ordered import time_folds
    from pyspark.ml.feature import VectorAssembler

    rows = time_folds(late, 3).toPandas()
    want = {}
    for r in trials.collect():
        scores = []
        for fold in (1, 2, 3):
            train = rows[rows["fold"] != fold]
            means = train[FEATURES].astype(float).mean()
            filled = rows[["fold", "y"]].join(rows[FEATURES].astype(float).fillna(means))
            assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(spark.createDataFrame(filled))
            params = {one_tree.getParam(k): int(v) for k, v in r["params"].items()}
            model = one_tree.copy(params).fit(assembled.filter(F.col("fold") != fold))
            out = model.transform(assembled.filter(F.col("fold") == fold)).toPandas()
            scores.append(1 - ((out.y - out.prediction) ** 2).sum() / ((out.y - out.y.mean()) ** 2).sum())
        want[r["trial_id"]] = np.mean(scores)
        np.testing.assert_allclose(r["mean_score"], want[r["trial_id"]], rtol=1e-9)
    top = trials.filter(F.col("trial_id") == max(want, key=want.get)).first()["params"]
    assert best.getOrDefault("maxDepth") == int(top["maxDepth"])


def test_report_holds_search_training_and_holdout(table):
    grid = {"maxDepth": [1, 3], "stepSize": [0.1, 0.3]}
    report = trees.search_report(table, FEATURES, trees.gbt(maxIter=5), grid, 2, "gbt", n_iter=2, folds=3).collect()
    by_split = {r["split"]: r for r in report}
    assert set(by_split) == {"train", "test"} and by_split["test"]["n"] == 24
    for r in report:
        assert set(r["params"]) == {"maxDepth", "stepSize"} and r["features_used"][0] == "x_a"
        assert r["cv_r2"] == report[0]["cv_r2"] and np.isfinite(r["cv_r2"])
    assert by_split["train"]["r2"] > 0.5


def _counted(df):
    """The rows, and how many of them were computed so far, repeats included."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema), seen


def test_ranking_and_refit_compute_their_rows_once(table):
    rows, seen = _counted(table)
    one_tree = trees.forest(numTrees=1, maxDepth=2)
    trees.rank_refit_score(rows, FEATURES, one_tree, 1, ["series_id", "ds"], "forest").collect()
    assert seen.value == 120


def test_refit_query_builds_its_panel_once_for_all_models(spark, sf, monkeypatch):
    from panelcast.plans import market, queries

    panel = market.model_panel(spark, sf, fine=True)
    rows, seen = _counted(panel)
    small = {
        "gbt": trees.gbt(maxIter=3, maxDepth=2),
        "gbt_alt": trees.gbt(seed=24, maxIter=2, maxDepth=2, subsamplingRate=0.8),
        "forest": trees.forest(numTrees=3, maxDepth=2),
    }
    monkeypatch.setattr(market, "model_panel", lambda *_, **__: rows)
    monkeypatch.setattr(queries, "_ensembles", lambda: small)
    together = rows_of(queries.refit_topk_score(spark, sf), "model", "split")
    assert seen.value == panel.count() > 0
    apart = []
    for label, estimator in small.items():
        scores = trees.rank_refit_score(panel, queries.MODEL_FEATURES, estimator, 2, ["series_id", "ds"], label)
        apart += rows_of(queries.rounded(scores, 6), "model", "split")
    assert together == sorted(apart)
