"""Tree ensembles on panel tables: fit, rank, search, refit on the best features."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.expressions import named
from panelcast.operators.lineage import cut
from panelcast.operators.metrics import metrics, union_trials
from panelcast.operators.ordered import random_split, time_folds
from panelcast.operators.shape import ranked_names, top_k
from panelcast.operators.stats import fill_own_mean

MAX_DEPTH = 30  # fixed value: the deepest tree the library grows
KEY = ("series_id", "ds")
PART_ROWS = 200_000
LEAST_PARTS = 4


def prepare(
    df: DataFrame, features: Sequence[str], by: Sequence[str] = (), flag: bool = False
) -> tuple[DataFrame, list[str]]:
    """Fill gaps with column means (tree trainers reject NaN) and assemble ``features``.

    ``flag`` adds a 0/1 column per feature that tells where a value was missing.
    """
    filled = fill_own_mean(df, features, by, flag=flag)
    names = [*features, *[f"{c}_missing" for c in features]] if flag else list(features)
    return VectorAssembler(inputCols=names, outputCol="features").transform(filled), names


def laid_out(df: DataFrame, key: Sequence[str] = KEY, label: str = "y") -> DataFrame:
    """The rows written in partitions and an order that follow from the rows alone.

    Trainers draw rows by their place in a partition, so the same rows in another layout give another model. Here
    the number of partitions follows the number of rows, a row's partition the hash of its key, and its
    place the key and the label.
    """
    rows = cut(df)
    parts = max(LEAST_PARTS, -(-rows.count() // PART_ROWS))
    order = [named(c) for c in [*key, label]]
    return cut(rows.repartition(parts, *[named(c) for c in key]).sortWithinPartitions(*order))


def _checked_depth(params: Mapping[str, object]) -> None:
    if int(params.get("maxDepth", 0)) > MAX_DEPTH:
        raise ValueError(f"trees grow to depth {MAX_DEPTH} at most")


def gbt(label: str = "y", seed: int = 21, **params: object) -> GBTRegressor:
    _checked_depth(params)
    return GBTRegressor(featuresCol="features", labelCol=label, seed=seed, **params)


def forest(label: str = "y", seed: int = 21, **params: object) -> RandomForestRegressor:
    _checked_depth(params)
    return RandomForestRegressor(featuresCol="features", labelCol=label, seed=seed, **params)


def fit_predict(
    df: DataFrame,
    features: Sequence[str],
    estimator: Estimator,
    keep: Sequence[str],
    key: Sequence[str] = KEY,
) -> DataFrame:
    """Fit on all rows and return (keep, yhat). The prepared table is read many times by the
    trainer, so it is written once to the checkpoint folder, laid out by ``key``."""
    assembled = laid_out(prepare(df, features)[0], key, estimator.getOrDefault("labelCol"))
    model = estimator.fit(assembled)
    scored = model.transform(assembled)
    return scored.select(*[named(c) for c in keep], F.col("prediction").alias("yhat"))


def importance_frame(df: DataFrame, model: Model, names: Sequence[str], label: str) -> DataFrame:
    """(model, attribute, importance): one row per feature of a fitted ensemble."""
    scores = [float(v) for v in model.featureImportances.toArray()]
    return df.sparkSession.createDataFrame(
        [(label, n, s) for n, s in zip(names, scores)],
        "model string, attribute string, importance double",
    )


def rank_importance(importances: DataFrame, k: int) -> DataFrame:
    """The k best attributes per model with their rank."""
    from pyspark.sql import Window

    order = Window.partitionBy("model").orderBy(F.desc("importance"), "attribute")
    best = top_k(importances, "importance", k, ["attribute"], ["model"])
    return best.withColumn("rank", F.row_number().over(order))


def _drawn(estimator: Estimator, grid: Mapping[str, Sequence[object]], n_iter: int, seed: int) -> list[dict]:
    """At most ``n_iter`` points of the grid, drawn by the seed."""
    builder = ParamGridBuilder()
    for name in sorted(grid):
        builder = builder.addGrid(estimator.getParam(name), list(grid[name]))
    points = builder.build()
    draws = random.Random(seed).sample(range(len(points)), min(n_iter, len(points)))
    return [points[i] for i in sorted(draws)]


def _r2(label: str, prediction: str) -> Column:
    error = named(label) - named(prediction)
    spread = F.var_pop(named(label)) * F.count(F.lit(1))
    return F.lit(1.0) - F.sum(error * error) / F.nullif(spread, F.lit(0.0))


def random_search(
    df: DataFrame,
    features: Sequence[str],
    estimator: Estimator,
    grid: Mapping[str, Sequence[object]],
    n_iter: int = 10,
    folds: int = 5,
    seed: int = 21,
    parallelism: int = 8,
    ds: str = "ds",
    key: Sequence[str] = KEY,
) -> tuple[DataFrame, Model]:
    """Random draws from a grid, scored by mean R2 over contiguous time folds.

    Returns the trial log (trial_id, params, mean_score) and the best model, refitted on all rows. Gaps of a fold's
    rows are filled with means of the other folds, so a held-out fold has no part in its training table. A
    fold's table is written once, all draws fit on it side by side, and one pass scores all of them.
    A fold whose target is constant has no score and does not count.
    """
    maps, label = _drawn(estimator, grid, n_iter, seed), estimator.getOrDefault("labelCol")
    columns = [*key, label, "fold"]
    folded = cut(time_folds(df, folds, ds).select(*[named(c) for c in dict.fromkeys([*columns, *features])]))
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    scores: list[list[float]] = [[] for _ in maps]
    with ThreadPoolExecutor(parallelism) as pool:
        for fold in range(1, folds + 1):
            apart = F.col("fold") == fold
            filled = fill_own_mean(folded, features, fit_on=folded.filter(~apart))
            table = assembler.transform(filled).select(*[named(c) for c in columns], "features")
            table = laid_out(table, key, label)
            train, scored = table.filter(~apart), table.filter(apart)
            models = list(pool.map(lambda m: estimator.copy(m).fit(train), maps))
            for i, model in enumerate(models):
                scored = model.setPredictionCol(f"__p{i}").transform(scored)
            row = scored.agg(*[_r2(label, f"__p{i}") for i in range(len(models))]).first()
            for kept, value in zip(scores, row):
                if value is not None:
                    kept.append(float(value))
    means = [sum(kept) / len(kept) if kept else float("-inf") for kept in scores]
    log = [
        (i, {p.name: str(v) for p, v in m.items()}, mean) for i, (m, mean) in enumerate(zip(maps, means), 1)
    ]
    trials = df.sparkSession.createDataFrame(
        log, "trial_id int, params map<string,string>, mean_score double"
    )
    best = maps[max(range(len(maps)), key=means.__getitem__)]
    everything = laid_out(prepare(df, features)[0], key, label)
    return trials, estimator.copy(best).fit(everything)


def search_report(
    df: DataFrame,
    features: Sequence[str],
    estimator: Estimator,
    grid: Mapping[str, Sequence[object]],
    k: int,
    label: str,
    n_iter: int = 10,
    folds: int = 5,
    frac: float = 0.2,
    seed: int = 21,
    key: Sequence[str] = KEY,
) -> DataFrame:
    """(model, params, cv_r2, split, n, r2, mae, features_used): search, training score and holdout of one model.

    The holdout is drawn first. Draws are scored on folds of the training rows; the best one ranks the features on
    the training rows, is refitted on the ``k`` best and scored on training and held-out rows.
    """
    train = cut(random_split(df, key, frac, seed)).filter("split = 'train'").drop("split")
    trials, model = random_search(train, features, estimator, grid, n_iter, folds, seed, key=key)
    chosen = {p: model.getOrDefault(model.getParam(p.name)) for p in _drawn(estimator, grid, 1, seed)[0]}
    scores = rank_refit_score(df, features, estimator.copy(chosen), k, key, label, frac, seed)
    params = F.create_map(*[x for p, v in chosen.items() for x in (F.lit(p.name), F.lit(str(v)))])
    best = trials.agg(F.max("mean_score")).first()[0]
    return scores.select(
        "model", params.alias("params"), F.lit(best).alias("cv_r2"), "split", "n", "r2", "mae", "features_used"
    )


def rank_refit_scores(
    df: DataFrame,
    features: Sequence[str],
    estimators: Mapping[str, Estimator],
    k: int,
    key: Sequence[str],
    frac: float = 0.2,
    seed: int = 21,
    target: str = "y",
    parallelism: int = 8,
) -> DataFrame:
    """Rank features on the training rows, refit on the k best, score both parts: each labelled model on one split.

    The holdout is drawn before the ranking, so it has no part in choosing the features. The draw
    reads the rows twice, so they are written before it, and the fits read the split table, so that is written
    too: the rows are computed once, however many the models. All models rank on the same laid-out table, side by side.
    """
    split = cut(random_split(cut(df), key, frac, seed))
    train = split.filter("split = 'train'")
    assembled, names = prepare(train, features)
    goals = {estimator.getOrDefault("labelCol") for estimator in estimators.values()}
    tables = {goal: laid_out(assembled, key, goal) for goal in goals}

    def scores(label: str) -> DataFrame:
        estimator = estimators[label]
        goal = estimator.getOrDefault("labelCol")
        ranking = importance_frame(df, estimator.fit(tables[goal]), names, label)
        best = ranked_names(ranking, k)
        both = fill_own_mean(split, best, fit_on=train)
        both = laid_out(VectorAssembler(inputCols=best, outputCol="features").transform(both), key, goal)
        model = estimator.fit(both.filter("split = 'train'"))
        scored = model.transform(both).withColumnRenamed("prediction", "yhat")
        return metrics(scored, target, "yhat", ["split"]).select(
            F.lit(label).alias("model"),
            "split",
            "n",
            "r2",
            "mae",
            F.array(*[F.lit(b) for b in best]).alias("features_used"),
        )

    with ThreadPoolExecutor(parallelism) as pool:
        return union_trials(list(pool.map(scores, estimators)))


def rank_refit_score(
    df: DataFrame,
    features: Sequence[str],
    estimator: Estimator,
    k: int,
    key: Sequence[str],
    label: str,
    frac: float = 0.2,
    seed: int = 21,
    target: str = "y",
) -> DataFrame:
    """The scores of one model."""
    return rank_refit_scores(df, features, {label: estimator}, k, key, frac, seed, target)
