"""Penalised regression and its choice of penalty, for every group, from sums of products alone.

The rows of a group are reduced to one matrix of sums of products per fold, in a single aggregation. The
matrix without a fold is the total minus the fold's, so every training set of a cross-validation, every
penalty and every mix of the two penalties is solved from the same sums, and every held-out score
follows from the fold's own sums. Rows are read once, whatever the number of fits.

The objective is that of the elastic net on standardised columns and target:
|| y - X b ||^2 / 2n + penalty (l1_ratio |b|_1 + (1 - l1_ratio) |b|^2 / 2).
A penalty of 0 is plain least squares; with ``l1_ratio`` 1 no coefficient is left from a penalty of 1 on.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.expressions import missing_to_null, named
from panelcast.operators.gram import gram
from panelcast.operators.lineage import cut
from panelcast.operators.stats import with_stats

PENALTIES = (0.0, 0.001, 0.01, 0.1, 0.3)
RATIOS = (0.0, 0.5, 1.0)
SWEEPS = 20_000
SETTLED = 1e-12  # largest change of a coefficient in a last sweep
FLAT = 1e-20  # variance of a globally scaled column that counts as none


def descend(xx: np.ndarray, xy: np.ndarray, lasso: np.ndarray, ridge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinate descent with soft thresholds for a batch of problems: coefficients, and whether settled.

    ``xx`` (problem, k, k) are correlations with a diagonal of 1 (0 for a constant column), ``xy``
    (problem, k) correlations with the target.
    """
    k = xy.shape[1]
    beta, done = np.zeros_like(xy), np.zeros(len(xy), bool)
    active = np.arange(len(xy))
    for _ in range(SWEEPS):
        a, c, l1, l2, b = xx[active], xy[active], lasso[active], ridge[active], beta[active]
        change = np.zeros(len(active))
        for j in range(k):
            pull = c[:, j] - np.einsum("pi,pi->p", a[:, j], b) + a[:, j, j] * b[:, j]
            size = a[:, j, j] + l2
            new = np.sign(pull) * np.maximum(np.abs(pull) - l1, 0.0) / np.where(size > 0, size, 1.0)
            new = np.where(a[:, j, j] > 0, new, 0.0)
            change = np.maximum(change, np.abs(new - b[:, j]))
            b[:, j] = new
        beta[active] = b
        done[active[change < SETTLED]] = True
        active = active[change >= SETTLED]
        if not len(active):
            break
    return beta, done


def violation(xx: np.ndarray, xy: np.ndarray, beta: np.ndarray, lasso: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """How far a solution is from its optimality conditions, the largest over the columns."""
    slope = xy - np.einsum("pij,pj->pi", xx, beta) - ridge[:, None] * beta
    on = np.abs(slope - np.sign(beta) * lasso[:, None])
    off = np.maximum(np.abs(slope) - lasso[:, None], 0.0)
    return np.where(beta != 0, on, off).max(axis=1, initial=0.0)


def standardized(n: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, ...]:
    """Means, deviations (columns, then target) and correlations from sums of products with a constant."""
    count = np.maximum(n, 1)[:, None]
    mean = g[:, 0, 1:] / count
    spread = g[:, 1:, 1:] / count[:, :, None] - mean[:, :, None] * mean[:, None, :]
    variance = np.einsum("pii->pi", spread).copy()
    variance[variance < FLAT] = 0.0
    sd = np.sqrt(variance)
    unit = np.where(sd > 0, sd, 1.0)
    scaled = spread / unit[:, :, None] / unit[:, None, :]
    level = sd > 0
    scaled = scaled * level[:, :, None] * level[:, None, :]
    return mean, sd, scaled[:, :-1, :-1], scaled[:, :-1, -1]


def solve_paths(n: np.ndarray, g: np.ndarray, penalties: Sequence[float], ratios: Sequence[float]) -> dict[str, np.ndarray]:
    """All penalties and ratios for a batch of sums: arrays by (problem, ratio x penalty)."""
    mean, sd, xx, xy = standardized(n, g)
    k, trials = xy.shape[1], [(r, p) for r in ratios for p in penalties]
    ratio, penalty = np.array(trials).T
    many = len(trials)
    wide_xx, wide_xy = np.repeat(xx, many, axis=0), np.repeat(xy, many, axis=0)
    lasso, ridge = np.tile(penalty * ratio, len(n)), np.tile(penalty * (1 - ratio), len(n))
    beta, done = descend(wide_xx, wide_xy, lasso, ridge)
    gap = violation(wide_xx, wide_xy, beta, lasso, ridge)
    unit = sd[:, -1:, None] / np.where(sd > 0, sd, 1.0)[:, None, :-1]  # back to the columns' units
    coef = beta.reshape(len(n), many, k) * unit.reshape(len(n), 1, k)
    const = mean[:, -1:] - np.einsum("pmk,pk->pm", coef, mean[:, :-1])
    return {
        "coef": np.concatenate([const[:, :, None], coef], axis=2),
        "gap": gap.reshape(len(n), many),
        "done": done.reshape(len(n), many),
        "ratio": ratio,
        "penalty": penalty,
    }


def errors_of(g: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """Sums of squared errors (problem, trial) of coefficients (problem, trial, constant and columns)."""
    full = np.concatenate([coef, np.full((*coef.shape[:2], 1), -1.0)], axis=2)
    return np.maximum(np.einsum("pmi,pij,pmj->pm", full, g, full), 0.0)


def _unpacked(values: Sequence, width: int) -> np.ndarray:
    upper = np.triu_indices(width)
    g = np.zeros((len(values), width, width))
    if len(values):
        g[:, upper[0], upper[1]] = np.vstack(list(values))
        g[:, upper[1], upper[0]] = g[:, upper[0], upper[1]]
    return g


def _sums(
    df: DataFrame, features: Sequence[str], y: str, by: Sequence[str], groups: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Sums of products per ``by`` and ``groups`` of [1, features, y], and the scales of the columns.

    Columns are moved and scaled by the whole table's mean and deviation first, so that products stay of
    one size; fits do not depend on it.
    """
    cols = [*features, y]
    rows = df.select(
        *[named(c) for c in [*by, *groups]], *[missing_to_null(named(c)).alias(c) for c in cols]
    ).na.drop(subset=cols)
    stats = {}
    for i, c in enumerate(cols):
        stats[f"m{i}"] = F.avg(named(c))
        stats[f"s{i}"] = F.when(F.stddev_pop(named(c)) > 0, F.stddev_pop(named(c))).otherwise(1.0)

    def build(get):
        moved = [((named(c) - get(f"m{i}")) / get(f"s{i}")).alias(f"__c{i}") for i, c in enumerate(cols)]
        return [*[named(c) for c in [*by, *groups]], *moved]

    terms = [F.lit(1.0), *[F.col(f"__c{i}") for i in range(len(cols))]]
    packed = F.struct(*[c.alias(n) for n, c in stats.items()])
    scales = rows.agg(packed.alias("__scale"))
    return gram(with_stats(rows, stats, (), build, None), [*by, *groups], terms), scales


def _in_units(coef: np.ndarray, scale: dict, k: int) -> np.ndarray:
    """Coefficients for the columns as they are."""
    m, s = ([scale[f"{x}{i}"] for i in range(k + 1)] for x in "ms")
    m, s = np.array(m, float), np.array(s, float)
    slopes = coef[..., 1:] * s[-1] / s[:-1]
    const = m[-1] + s[-1] * coef[..., 0] - slopes @ m[:-1]
    return np.concatenate([const[..., None], slopes], axis=-1)


def elastic_net(
    df: DataFrame,
    features: Sequence[str],
    penalties: Sequence[float] = PENALTIES,
    l1_ratios: Sequence[float] = (1.0,),
    y: str = "y",
    by: Sequence[str] = (),
) -> DataFrame:
    """(by, l1_ratio, penalty, term, coefficient, n, r2, gap, settled): the whole path of penalties.

    One row per term, 'const' and the features, in units of the data. ``gap`` is the largest violation of
    the optimality conditions. A constant feature, and every feature of a constant target, has coefficient 0. Rows with
    a missing value do not count. Features that determine each other share their weight as the descent leaves it.
    """
    k, width = len(features), len(features) + 2
    sums, scales = _sums(df, features, y, by, ())
    names = ["const", *features]

    @F.pandas_udf(
        "array<struct<l1_ratio:double,penalty:double,coef:array<double>,r2:double,gap:double,settled:boolean>>"
    )
    def solve(n: pd.Series, grams: pd.Series, scale: pd.DataFrame) -> pd.Series:
        g = _unpacked(grams, width)
        count = n.to_numpy(float)
        found = solve_paths(count, g, penalties, l1_ratios)
        errors = errors_of(g, found["coef"])
        total = g[:, -1, -1] - g[:, 0, -1] ** 2 / np.maximum(count, 1)
        out = []
        for i in range(len(count)):
            coef = _in_units(found["coef"][i], scale.iloc[i], k)
            out.append(
                [
                    {
                        "l1_ratio": found["ratio"][t],
                        "penalty": found["penalty"][t],
                        "coef": coef[t],
                        "r2": 1 - errors[i, t] / total[i] if total[i] > FLAT * count[i] else None,
                        "gap": found["gap"][i, t],
                        "settled": bool(found["done"][i, t]),
                    }
                    for t in range(len(found["ratio"]))
                ]
            )
        return pd.Series(out)

    keys = [named(c) for c in by]
    one = cut(sums).withColumn("__scale", scales.scalar())
    paths = one.filter("n > 0").select(*keys, "n", F.explode(solve("n", "gram", "__scale")).alias("p"))
    return paths.select(
        *keys, "p.l1_ratio", "p.penalty", F.posexplode("p.coef").alias("__at", "coefficient"),
        "n", F.col("p.r2").alias("r2"), F.col("p.gap").alias("gap"), F.col("p.settled").alias("settled"),
    ).select(
        *keys, "l1_ratio", "penalty", F.get(F.array(*[F.lit(c) for c in names]), F.col("__at")).alias("term"),
        "coefficient", "n", "r2", "gap", "settled",
    )


def cross_validate(
    df: DataFrame,
    features: Sequence[str],
    penalties: Sequence[float] = PENALTIES,
    l1_ratios: Sequence[float] = RATIOS,
    y: str = "y",
    by: Sequence[str] = (),
    fold: str = "fold",
) -> DataFrame:
    """(by, trial_id, l1_ratio, penalty, fold, n, r2, mse): every point of the grid scored on every fold.

    ``df`` holds the number of its fold in a column, as ``time_folds`` and ``series_folds`` append it. A fit sees all
    rows of its group but the fold's; columns are standardised on those. R2 is against the fold's own mean, and
    NULL where the fold is constant. Rows with a missing value do not count. A group with a single fold has no rows.
    """
    k, width = len(features), len(features) + 2
    sums, scales = _sums(df, features, y, by, [fold])
    keys = [named(c) for c in by]
    item = F.struct(named(fold).cast("long").alias("fold"), "n", "gram")
    gathered = cut(sums).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("__folds"))
    unit = scales.select(F.col(f"__scale.s{k}")).scalar()

    @F.pandas_udf("array<struct<trial_id:int,l1_ratio:double,penalty:double,fold:long,n:long,r2:double,mse:double>>")
    def score(groups: pd.Series, units: pd.Series) -> pd.Series:
        out = []
        for folds, unit in zip(groups, units):
            n = np.array([f["n"] for f in folds], float)
            g = _unpacked([f["gram"] for f in folds], width)
            rest_n, rest = n.sum() - n, g.sum(axis=0) - g  # all folds but one
            rows = []
            if len(folds) > 1:
                found = solve_paths(rest_n, rest, penalties, l1_ratios)
                errors = errors_of(g, found["coef"])
                total = g[:, -1, -1] - g[:, 0, -1] ** 2 / n
                for i, f in enumerate(folds):
                    for t, (ratio, penalty) in enumerate(zip(found["ratio"], found["penalty"])):
                        level = total[i] > FLAT * n[i]
                        rows.append(
                            {
                                "trial_id": t + 1, "l1_ratio": ratio, "penalty": penalty, "fold": f["fold"], "n": f["n"],
                                "r2": 1 - errors[i, t] / total[i] if level else None, "mse": errors[i, t] / n[i] * unit**2,
                            }
                        )
            out.append(rows)
        return pd.Series(out)

    return gathered.withColumn("__unit", unit).select(*keys, F.inline(score("__folds", "__unit")))


def refit_best(paths: DataFrame, best: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The rows of ``elastic_net`` over the same grid that belong to each group's best point."""
    return paths.join(best, [*by, "l1_ratio", "penalty"])


def grid_search(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, trial_id, l1_ratio, penalty, mean_r2): the point of the grid with the best mean fold score."""
    keys = [named(c) for c in by]
    means = scores.groupBy(*keys, "trial_id", "l1_ratio", "penalty").agg(F.avg("r2").alias("mean_r2"))
    best = F.min(F.struct((-F.col("mean_r2")).alias("__worst"), "trial_id", "l1_ratio", "penalty", "mean_r2"))
    return means.filter("mean_r2 is not null").groupBy(*keys).agg(best.alias("b")).select(
        *keys, "b.trial_id", "b.l1_ratio", "b.penalty", "b.mean_r2"
    )
