"""Vector autoregression: several columns of a series explained by the past of all of them.

All equations share one design (a constant and the lags of every column), so one matrix of sums of
products per series holds every number of lags up to the bound. The rows are reduced once; a solve
per series chooses the number of lags by AIC, and the joint forecast recurses on the last rows only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.expressions import missing_to_null, named
from panelcast.operators.gram import gram
from panelcast.operators.lineage import cut
from panelcast.operators.ordered import join_series, over_rows

SINGULAR = 1e-10  # smallest eigenvalue of a design's correlations that counts as full rank


def align_series(
    panel: DataFrame, names: Sequence[str], y: str = "y", key: str = "series_id", order: str = "ds"
) -> DataFrame:
    """(order, one column per named series): a long panel side by side, rows matched by ``order``."""
    rows = panel.filter(named(key).isin(list(names)))
    return rows.groupBy(named(order)).pivot(key, list(names)).agg(F.first(missing_to_null(named(y))))


def companion_radius(coefficients: np.ndarray) -> float:
    """Largest absolute eigenvalue of the companion matrix of (lag, equation, column) coefficients."""
    lags, k = coefficients.shape[:2]
    if not lags:
        return 0.0
    top = np.concatenate(list(coefficients), axis=1)
    below = np.eye(k * (lags - 1), k * lags)
    return float(np.abs(np.linalg.eigvals(np.concatenate([top, below]))).max())


def _solve(k: int, max_lags: int, fixed: bool):
    """Column function (n, gram, mean, sd) -> the fit with the smallest AIC, in units of the data."""
    width = 1 + k * max_lags + k

    @F.pandas_udf(
        "struct<lags:int, aic:double, radius:double, const:array<double>, coef:array<double>, "
        "se:array<double>, sigma:array<double>, reason:string>"
    )
    def solve(n: pd.Series, grams: pd.Series, means: pd.Series, deviations: pd.Series) -> pd.DataFrame:
        out, upper = [], np.triu_indices(width)
        for count, values, mean, sd in zip(n, grams, means, deviations):
            g = np.zeros((width, width))
            g[upper] = values
            g = g + np.triu(g, 1).T
            mean, sd = np.array(mean, float), np.array(sd, float)
            yy = g[-k:, -k:]
            best = None
            for lags in [max_lags] if fixed else range(1, max_lags + 1):
                m = 1 + k * lags
                xx, xy = g[:m, :m], g[:m, -k:]
                size = np.sqrt(np.maximum(np.diag(xx), 1e-300))
                values, vectors = np.linalg.eigh(xx / size / size[:, None])
                if values[0] < SINGULAR or count <= m:
                    continue
                inverse = (vectors / values) @ vectors.T / size / size[:, None]
                beta = inverse @ xy
                rest = yy - beta.T @ xy
                with np.errstate(divide="ignore", invalid="ignore"):
                    sign, logdet = np.linalg.slogdet(rest / count)
                aic = count * logdet + 2 * k * m if sign > 0 else -np.inf
                if best is None or aic < best[0]:
                    best = aic, lags, beta, inverse, rest / (count - m)
            if best is None:
                out.append((None, None, None, None, None, None, None, "singular"))
                continue
            aic, lags, beta, inverse, sigma = best
            se = np.sqrt(np.maximum(np.outer(np.diag(inverse), np.diag(sigma)), 0.0))
            unit = sd[None, :] / sd[:, None]  # (column, equation)
            coef = beta[1:].reshape(lags, k, k) * unit
            shift = np.einsum("ljk,j->k", coef, mean)
            const = mean + sd * beta[0] - shift
            # the constant's error, from the design in units of the data
            back = np.concatenate([[1.0], np.tile(-mean / sd, lags)])
            const_se = np.sqrt(max(back @ inverse @ back, 0.0)) * np.sqrt(np.maximum(np.diag(sigma), 0.0)) * sd
            errors = np.concatenate([const_se[None, :], (se[1:].reshape(lags, k, k) * unit).reshape(-1, k)])
            radius = companion_radius(coef.transpose(0, 2, 1))
            out.append(
                (lags, float(aic), radius, const, coef.reshape(-1), errors.reshape(-1), (sigma * np.outer(sd, sd)).reshape(-1), None)
            )
        names = ["lags", "aic", "radius", "const", "coef", "se", "sigma", "reason"]
        return pd.DataFrame(out, columns=names)

    return solve.asNondeterministic()


def fit_var(
    panel: DataFrame,
    cols: Sequence[str],
    max_lags: int = 4,
    fixed: bool = False,
    by: Sequence[str] = ("series_id",),
    order: Sequence[str] = ("ds",),
    chunk: Column | None = None,
) -> DataFrame:
    """One row per series: lags, n, aic, radius, stable, const, coef, se, sigma, reason.

    ``coef`` is flat by (lag, column, equation), ``se`` has the constants before them, ``sigma`` is the
    covariance of the errors. ``radius`` is the largest eigenvalue of the companion matrix; below 1 the model is
    stable. The number of lags has the smallest AIC on the rows that have ``max_lags`` rows before them, or
    is ``max_lags`` itself with ``fixed``. Rows with a missing value are left out first. A series with
    too few rows or columns that depend on each other has NULLs and the reason 'singular'.
    """
    k, keys = len(cols), [named(c) for c in by]
    values = [missing_to_null(named(c)).alias(c) for c in cols]
    rows = panel.select(*keys, *[named(c) for c in order], *values).na.drop(subset=list(cols))
    deviation = [F.when(F.stddev_pop(named(c)) > 0, F.stddev_pop(named(c))).otherwise(1.0) for c in cols]
    facts = cut(
        rows.groupBy(*keys).agg(
            F.array(*[F.avg(named(c)) for c in cols]).alias("__mean"), F.array(*deviation).alias("__sd")
        )
    )
    known = join_series(rows, facts, by, order)
    scaled = [
        ((named(c) - F.get("__mean", F.lit(i))) / F.get("__sd", F.lit(i))).alias(f"__z{i}") for i, c in enumerate(cols)
    ]
    flat = known.select(*keys, *[named(c) for c in order], *scaled)

    def build(w: WindowSpec, position: Column, total: Column) -> dict[str, Column]:
        return {
            f"__z{i}_{lag}": F.lag(f"__z{i}", lag).over(w) for lag in range(1, max_lags + 1) for i in range(k)
        }

    lagged = over_rows(flat, by, order, max_lags, build, chunk)
    full = lagged.filter(F.col(f"__z0_{max_lags}").isNotNull())
    terms = [
        F.lit(1.0),
        *[F.col(f"__z{i}_{lag}") for lag in range(1, max_lags + 1) for i in range(k)],
        *[F.col(f"__z{i}") for i in range(k)],
    ]
    sums = gram(full, by, terms).join(facts, list(by))
    fits = sums.select(*keys, "n", _solve(k, max_lags, fixed)("n", "gram", "__mean", "__sd").alias("fit"))
    everyone = panel.select(*keys).distinct()
    model = everyone.join(fits.select(*keys, "n", "fit.*"), list(by), "left")
    return model.withColumns(
        {
            "stable": F.col("radius") < 1.0,
            "reason": F.when(F.col("lags").isNull(), F.coalesce("reason", F.lit("singular"))),
        }
    )


def var_coefficients(
    model: DataFrame, cols: Sequence[str], by: Sequence[str] = ("series_id",)
) -> DataFrame:
    """(by, equation, term, coefficient, std_error, t_value); terms are 'const' and 'L<lag>.<column>'."""
    k = len(cols)
    names = F.array(*[F.lit(c) for c in cols])
    whole = F.concat("const", "coef")
    place = F.col("pos").cast("int")
    at = F.floor(place / k).cast("int") - 1  # lag and column, from 0; -1 for the constant
    term = F.when(at < 0, "const").otherwise(
        F.concat(F.lit("L"), (F.floor(at / k) + 1).cast("string"), F.lit("."), F.get(names, at % k))
    )
    rows = model.filter("reason is null").select(
        *[named(c) for c in by], "se", F.posexplode(whole).alias("pos", "coefficient")
    )
    return rows.select(
        *[named(c) for c in by],
        F.get(names, place % k).alias("equation"),
        term.alias("term"),
        "coefficient",
        F.get("se", place).alias("std_error"),
    ).withColumn("t_value", F.col("coefficient") / F.nullif("std_error", F.lit(0.0)))


def forecast_var(
    model: DataFrame,
    history: DataFrame,
    future: DataFrame,
    cols: Sequence[str],
    by: Sequence[str] = ("series_id",),
    order: Sequence[str] = ("ds",),
    chunk: Column | None = None,
) -> DataFrame:
    """(by, order, <column>_hat of every column, reason) for every future row, by joint recursion.

    ``future`` must follow the history directly. Only the last rows of the history that a lag reaches and the
    keys of the future rows are gathered per series; time grows with the horizon. An unstable model, whose
    forecasts run away, gives NULLs with the reason 'unstable'; no model 'singular' or 'no model'.
    """
    k, keys, spine = len(cols), [named(c) for c in by], [named(c) for c in order]
    values = [missing_to_null(named(c)).alias(c) for c in cols]
    past = history.select(*keys, *spine, *values).na.drop(subset=list(cols))
    reach = model.agg(F.max("lags")).first()[0] or 1
    counted = over_rows(
        past, by, order, 0, lambda w, position, total: {"__left": total - position}, chunk
    )
    tail = F.array_sort(F.collect_list(F.struct(*spine, F.array(*[named(c) for c in cols]).alias("v"))))
    last = counted.filter(F.col("__left") < reach).groupBy(*keys).agg(
        F.flatten(F.transform(tail, lambda r: r["v"])).alias("__tail")
    )
    usable = model.filter("reason is null and stable")
    ahead = future.select(*keys, *spine)
    wanted = ahead.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*spine))).alias("__at"))
    work = wanted.join(usable.select(*keys, "lags", "const", "coef"), list(by)).join(last, list(by))
    hats = [f"{c}_hat" for c in cols]
    fields = [*[ahead.schema[c] for c in by], T.StructField("__at", wanted.schema["__at"].dataType)]
    doubles = T.ArrayType(T.DoubleType())

    def recurse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            paths = []
            columns = (batch[c] for c in ("lags", "const", "coef", "__tail", "__at"))
            for lags, const, coef, tail, at in zip(*columns):
                weights = np.array(coef).reshape(int(lags) * k, k)
                # the newest row first
                state = np.array(tail).reshape(-1, k)[::-1][: int(lags)].reshape(-1)
                path = np.empty((len(at), k))
                for h in range(len(path)):
                    path[h] = const + state @ weights
                    state = np.concatenate([path[h], state[:-k]])
                paths.append(path)
            made = batch[[*by, "__at"]].copy()
            for i, c in enumerate(hats):
                made[c] = [p[:, i] for p in paths]
            yield made

    schema = T.StructType([*fields, *[T.StructField(c, doubles) for c in hats]])
    paths = work.mapInPandas(recurse, schema).select(
        *keys, F.explode(F.arrays_zip("__at", *hats)).alias("__r")
    )
    paths = paths.select(
        *keys, *[F.col("__r.__at").getField(c).alias(c) for c in order], *[F.col("__r").getField(c).alias(c) for c in hats]
    )
    told = model.select(*keys, F.lit(True).alias("__known"), F.col("reason").alias("__reason"), "stable")
    reason = (
        F.when(F.col("__known").isNull(), "no model")
        .when(F.col("__reason").isNotNull(), F.col("__reason"))
        .when(~F.col("stable"), "unstable")
        .when(F.col(hats[0]).isNull(), "no history")
    )
    return (
        ahead.join(paths, [*by, *order], "left")
        .join(told, list(by), "left")
        .select(*keys, *spine, *hats, reason.alias("reason"))
    )
