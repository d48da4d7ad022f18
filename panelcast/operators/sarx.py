"""Seasonal autoregression with moving-average terms and regressors, for every series in one job.

The model of a series is the order (p, q, P, Q) with the smallest AIC among conditional least
squares fits on one common sample, after d = 1 regular and D = 0 or 1 seasonal differences.
Moving-average terms follow Hannan and Rissanen (1982): a long autoregression supplies residuals,
whose lags enter the design. Every order is a set of columns of one design, so all orders of a
series are solved from one Gram matrix and the data is reduced only twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from panelcast.functions.expressions import dot, named
from panelcast.operators.gram import gram, ols
from panelcast.operators.lineage import cut
from panelcast.operators.ordered import join_series, over_rows

ORDER = ("p", "q", "seasonal_p", "seasonal_q")
SINGULAR = 1e-9  # smallest eigenvalue of scaled columns that counts as full rank
SEASONAL_STRENGTH = 0.64  # fixed value: Wang, Smith and Hyndman (2006)


class Orders:
    """Bounds of the order search and the design they need.

    The bounds hold as given. ``history``, the training length, caps the lags at its third where it
    is named, so that a short series is not asked for seasonal terms it cannot fill.
    """

    def __init__(
        self,
        m: int = 12,
        max_p: int = 5,
        max_q: int = 5,
        max_P: int = 5,
        max_Q: int = 5,
        max_order: int = 5,
        history: int | None = None,
        long_ar: int | None = None,
    ) -> None:
        if long_ar is None:  # a season and the row before it
            long_ar = max(8, m + 1)
        most = max(max_p, max_q, long_ar, m * max(max_P, max_Q))
        room = most if history is None else max(history // 3, 1)
        self.m = m
        self.p = min(max_p, room, m - 1 if m > 1 else max_p)
        self.q = min(max_q, room, m - 1 if m > 1 else max_q)
        self.P = min(max_P, room // m) if m > 1 else 0
        self.Q = min(max_Q, room // m) if m > 1 else 0
        self.max_order = max_order
        self.long_ar = min(long_ar, room)

    @property
    def y_lags(self) -> list[int]:
        return [*range(1, self.p + 1), *[self.m * i for i in range(1, self.P + 1)]]

    @property
    def e_lags(self) -> list[int]:
        return [*range(1, self.q + 1), *[self.m * i for i in range(1, self.Q + 1)]]

    def names(self, exog: Sequence[str]) -> list[str]:
        return [
            "const",
            *[f"ar_{i}" for i in self.y_lags],
            *[f"ma_{i}" for i in self.e_lags],
            *exog,
        ]

    def candidates(self, exog: Sequence[str]) -> list[tuple[tuple[int, int, int, int], list[int]]]:
        """Every order within the bounds, with its columns of the full design."""
        found = []
        ranges = [range(self.p + 1), range(self.q + 1), range(self.P + 1), range(self.Q + 1)]
        a, b = 1 + self.p, 1 + self.p + self.P
        c = b + self.q
        d = c + self.Q
        for p, q, sp, sq in product(*ranges):
            if p + q + sp + sq <= self.max_order:
                columns = [0, *range(1, 1 + p), *range(a, a + sp), *range(b, b + q)]
                columns += [*range(c, c + sq), *range(d, d + len(exog))]
                found.append(((p, q, sp, sq), columns))
        return found


def fitting_orders(
    train: DataFrame,
    exog: Sequence[str] = (),
    m: int = 12,
    y: str = "y",
    by: Sequence[str] = ("series_id",),
    **bounds: int,
) -> Orders:
    """Bounds that the shortest series of the training rows can fill; rows with a missing value do not count."""
    rows = train.select(*[named(c) for c in by], named(y), *[named(c) for c in exog]).na.drop(subset=[y, *exog])
    sizes = rows.groupBy(*[named(c) for c in by]).agg(F.count(F.lit(1)).alias("n"))
    return Orders(m=m, history=sizes.agg(F.min("n")).first()[0] or 0, **bounds)


def seasonal_differences(
    panel: DataFrame,
    m: int = 12,
    y: str = "y",
    by: Sequence[str] = ("series_id",),
    order: Sequence[str] = ("ds",),
) -> DataFrame:
    """(by, strength, seasonal_d): D = 1 where the seasonal strength exceeds its threshold.

    The trend is a centred moving average over one season; the seasonal part is the mean per
    phase. Both variances follow from sums per (series, phase).
    """
    keys = [named(c) for c in by]
    everyone = panel.select(*keys).distinct()
    strength = _seasonal_strength(panel, m, y, by, order)
    return _with_seasonal_d(everyone.join(strength, list(by), "left"))


def _with_seasonal_d(df: DataFrame) -> DataFrame:
    """A series too short for one season has strength 0."""
    strength = F.coalesce("strength", F.lit(0.0))
    return df.withColumns(
        {"strength": strength, "seasonal_d": (strength > SEASONAL_STRENGTH).cast("int")}
    )


def _seasonal_strength(
    panel: DataFrame, m: int, y: str, by: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """(by, strength) for the series that span a season."""
    keys = [named(c) for c in by]
    if m < 2:
        return panel.select(*keys, F.lit(0.0).alias("strength")).limit(0)
    half = m // 2

    def build(w: WindowSpec, position: Column, total: Column) -> dict[str, Column]:
        v = named(y)
        if m % 2 == 0:
            middle = F.sum(v).over(w.rowsBetween(1 - m, -1))
            mean = (middle + (v + F.lag(v, m).over(w)) / 2.0) / m
        else:
            mean = F.avg(v).over(w.rowsBetween(1 - m, 0))
        return {
            "__detrended": F.lag(v, half).over(w) - mean,
            "__phase": (position - half) % m,
            "__pos": position,
        }

    rows = over_rows(panel, by, order, m, build)
    start = m + 1 if m % 2 == 0 else m
    phases = (
        rows.filter((F.col("__pos") >= start) & F.col("__detrended").isNotNull())
        .groupBy(*keys, "__phase")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("__detrended").alias("mean"),
            F.var_pop("__detrended").alias("var"),
        )
    )
    n = F.sum("n")
    within = F.sum(F.col("n") * F.col("var")) / n
    centre = F.sum(F.col("n") * F.col("mean")) / n
    between = F.sum(F.col("n") * F.col("mean") * F.col("mean")) / n - centre * centre
    strength = F.greatest(
        F.lit(0.0), F.lit(1.0) - within / F.nullif(within + between, F.lit(0.0))
    )
    return phases.groupBy(*keys).agg(strength.alias("strength"))


def _order_search(
    width: int, candidates: list[tuple[tuple[int, int, int, int], list[int]]], keep_log: bool
):
    """Column function (n, gram) -> the fit with the smallest AIC among all column sets.

    On equal AIC the earlier candidate wins. Coefficients of columns left out are zero. A candidate whose
    columns depend on each other is passed over.
    """
    order_fields = ", ".join(f"{name}:int" for name in ORDER)
    subsets = [columns for _, columns in candidates]
    labels = [dict(zip(ORDER, order), candidate=i) for i, (order, _) in enumerate(candidates)]
    numbers = np.array([order for order, _ in candidates], dtype="int32")
    names = ORDER

    @F.pandas_udf(
        f"struct<{order_fields}, n_obs:bigint, aic:double, sse:double, beta:array<double>, "
        f"se:array<double>, log:array<struct<candidate:int, {order_fields}, aic:double>>>"
    )
    def search(n: pd.Series, grams: pd.Series) -> pd.DataFrame:
        batch, k = len(n), width - 1
        g = np.zeros((batch, width, width))
        upper = np.triu_indices(width)
        if batch:
            g[:, upper[0], upper[1]] = np.vstack(grams.to_numpy())
            g[:, upper[1], upper[0]] = g[:, upper[0], upper[1]]
        rows = n.to_numpy(dtype=float)
        scale = np.sqrt(np.maximum(np.einsum("bii->bi", g), 1e-300))[:, :k]
        xx = g[:, :k, :k] / scale[:, :, None] / scale[:, None, :]
        xy = g[:, :k, k] / scale
        scores = np.full((batch, len(subsets)), np.inf)
        best = np.full(batch, np.inf)
        chosen = np.full(batch, -1)
        beta, se, total = np.zeros((batch, k)), np.zeros((batch, k)), np.zeros(batch)
        with np.errstate(divide="ignore", invalid="ignore"):
            for number, columns in enumerate(subsets):
                block = xx[:, columns][:, :, columns]
                inverse = np.linalg.inv(block + 1e-10 * np.eye(len(columns)))
                part = xy[:, columns]
                solved = np.einsum("bij,bj->bi", inverse, part)
                # One refinement takes back what the small diagonal added for stability changes.
                miss = part - np.einsum("bij,bj->bi", block, solved)
                solved = solved + np.einsum("bij,bj->bi", inverse, miss)
                sse = np.maximum(g[:, k, k] - np.einsum("bi,bi->b", solved, part), 0.0)
                free = rows - len(columns)
                aic = rows * np.log(sse / rows) + 2 * len(columns)
                full_rank = np.linalg.eigvalsh(block)[:, 0] > SINGULAR if batch else np.ones(0, bool)
                usable = (free > 2) & np.isfinite(aic) & full_rank
                scores[:, number] = np.where(usable, aic, np.inf)
                better = scores[:, number] < best
                spread = np.sqrt(
                    np.maximum(sse / free, 0.0)[:, None] * np.einsum("bii->bi", inverse)
                )
                full, full_se = np.zeros((batch, k)), np.zeros((batch, k))
                full[:, columns] = solved / scale[:, columns]
                full_se[:, columns] = spread / scale[:, columns]
                best = np.where(better, scores[:, number], best)
                chosen = np.where(better, number, chosen)
                total = np.where(better, sse, total)
                beta = np.where(better[:, None], full, beta)
                se = np.where(better[:, None], full_se, se)
        logs: list = [None] * batch
        if keep_log:
            logs = [
                [dict(labels[i], aic=line[i]) for i in np.flatnonzero(np.isfinite(line))]
                for line in scores
            ]
        found = pd.DataFrame(numbers[chosen], columns=list(names))
        found["n_obs"] = n.to_numpy()
        found["aic"] = np.where(chosen >= 0, best, np.nan)
        found["sse"] = total
        found["beta"] = list(beta)
        found["se"] = list(se)
        found["log"] = logs
        return found

    # evaluated once: a filter on its result must not be pushed through it
    return search.asNondeterministic()


def _scales(panel: DataFrame, y: str, exog: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per series: deviation of y, deviations of the regressors (1 where constant)."""

    def deviation(c: str) -> Column:
        sd = F.stddev_pop(named(c))
        return F.when(sd > 0, sd).otherwise(1.0)

    return panel.groupBy(*[named(c) for c in by]).agg(
        deviation(y).alias("y_scale"),
        F.array(*[deviation(c) for c in exog]).cast("array<double>").alias("x_scale"),
    )


def _stationary(
    rows: DataFrame, y: str, exog: Sequence[str], m: int, by: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Differenced, scaled target ``__z`` and regressors ``__x0..``; NULL before they exist."""

    def build(w: WindowSpec, position: Column, total: Column) -> dict[str, Column]:
        def differenced(v: Column) -> Column:
            plain = v - F.lag(v, 1).over(w)
            if m < 2:
                return plain
            season = plain - F.lag(v, m).over(w) + F.lag(v, m + 1).over(w)
            return F.when(F.col("seasonal_d") == 1, season).otherwise(plain)

        new = {"__pos": position, "__z": differenced(named(y) / F.col("y_scale"))}
        for i, c in enumerate(exog):
            new[f"__x{i}"] = differenced(named(c) / F.get("x_scale", F.lit(i)))
        return new

    return over_rows(rows, by, order, m + 1 if m > 1 else 1, build)


def _with_lags(
    rows: DataFrame, lags: dict[str, Sequence[int]], by: Sequence[str], order: Sequence[str]
) -> DataFrame:
    wanted = {c: list(ls) for c, ls in lags.items() if ls}
    if not wanted:
        return rows
    reach = max(max(ls) for ls in wanted.values())
    return over_rows(
        rows,
        by,
        order,
        reach,
        lambda w, position, total: {
            f"{c}_{i}": F.lag(c, i).over(w) for c, ls in wanted.items() for i in ls
        },
    )


def _long_ar_design(h: int, exog: Sequence[str]) -> list[Column]:
    return [
        F.lit(1.0),
        *[F.col(f"__z_{i}") for i in range(1, h + 1)],
        *[F.col(f"__x{i}") for i in range(len(exog))],
    ]


def _complete(columns: Sequence[Column]) -> Column:
    test = F.lit(True)
    for c in columns:
        test = test & c.isNotNull()
    return test


def fit_sarx(
    panel: DataFrame,
    exog: Sequence[str] = (),
    orders: Orders | None = None,
    y: str = "y",
    by: Sequence[str] = ("series_id",),
    order: Sequence[str] = ("ds",),
    keep_log: bool = False,
) -> DataFrame:
    """One model row per series: order, AIC, coefficients, standard errors and scales.

    With ``keep_log`` the column ``log`` holds (candidate, order, aic) of every order tried.
    """
    orders = orders or Orders()
    keys = [named(c) for c in by]
    rows = panel.select(*keys, *[named(c) for c in order], named(y), *[named(c) for c in exog])
    rows = rows.na.drop(subset=[y, *exog])
    scales = _scales(rows, y, exog, by)
    seasonal = _seasonal_strength(rows, orders.m, y, by, order)
    # one row per series, read by several passes
    facts = cut(_with_seasonal_d(scales.join(seasonal, list(by), "left")))
    flat = _stationary(join_series(rows, facts, by, order), y, exog, orders.m, by, order)

    h = orders.long_ar
    design = _long_ar_design(h, exog)
    lagged = _with_lags(flat, {"__z": range(1, h + 1)}, by, order)
    target = F.col("__z")
    first_pass = gram(lagged.filter(_complete([*design, target])), by, [*design, target])
    long_fit = cut(
        first_pass.select(
            *keys, ols(len(design) + 1)("n", "gram").getField("beta").alias("ar_beta")
        )
    )

    known = join_series(lagged, long_fit, by, order).withColumn(
        "__e", target - dot(F.col("ar_beta"), F.array(*design))
    )
    known = known.drop(*[f"__z_{i}" for i in range(1, h + 1)])
    full = _with_lags(known, {"__z": orders.y_lags, "__e": orders.e_lags}, by, order)
    terms = [
        F.lit(1.0),
        *[F.col(f"__z_{i}") for i in orders.y_lags],
        *[F.col(f"__e_{i}") for i in orders.e_lags],
        *[F.col(f"__x{i}") for i in range(len(exog))],
        target,
    ]
    candidates = orders.candidates(exog)
    kept = ("y_scale", "x_scale", "strength", "seasonal_d", "ar_beta")
    # arrays among the aggregates would sort the data rows; the facts join the sums
    sums = gram(full.filter(_complete([*terms, F.col("__e")])), by, terms)
    sums = sums.join(facts, list(by)).join(long_fit, list(by))
    search = _order_search(len(terms), candidates, keep_log)
    fits = sums.select(*keys, *kept, search("n", "gram").alias("fit"))
    model = fits.select(*keys, *kept, "fit.*")
    return model.filter(~F.isnan("aic")) if keep_log else model.filter(~F.isnan("aic")).drop("log")


def order_search_log(model: DataFrame, by: Sequence[str] = ("series_id",)) -> DataFrame:
    """Long trial log of a model fitted with ``keep_log``, one row per series and order."""
    return model.select(*[named(c) for c in by], F.inline("log"))


def coef_table(
    model: DataFrame,
    exog: Sequence[str] = (),
    orders: Orders | None = None,
    by: Sequence[str] = ("series_id",),
) -> DataFrame:
    """(by, term, coefficient, std_error, t_value) of the chosen order, in units of the data."""
    orders = orders or Orders()
    names = orders.names(exog)
    plain = len(names) - len(exog)

    def unit(i: int) -> Column:
        if i == 0:
            return F.col("y_scale")
        if i < plain:
            return F.lit(1.0)
        return F.col("y_scale") / F.get("x_scale", F.lit(i - plain))

    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("term"),
                (F.get("beta", F.lit(i)) * unit(i)).alias("coefficient"),
                (F.get("se", F.lit(i)) * unit(i)).alias("std_error"),
            )
            for i, name in enumerate(names)
        ]
    )
    return (
        model.select(*[named(c) for c in by], F.inline(entries))
        .filter(F.col("std_error") > 0)
        .withColumn("t_value", F.col("coefficient") / F.col("std_error"))
    )


def forecast_sarx(
    model: DataFrame,
    history: DataFrame,
    future: DataFrame,
    exog: Sequence[str] = (),
    orders: Orders | None = None,
    y: str = "y",
    by: Sequence[str] = ("series_id",),
    order: Sequence[str] = ("ds",),
) -> DataFrame:
    """(by, order columns, yhat, reason) for every future row, by recursion inside each series.

    Only the last rows of the history that a lag can reach, and the future rows, are gathered per
    series. ``future`` holds the regressors and must follow the history directly. From the first
    missing regressor or past value that the model uses on, ``yhat`` is NULL with the reason
    'missing input'; a series without a model or history has NULLs with the reason 'no model'.
    """
    orders = orders or Orders()
    m = orders.m
    keys = [named(c) for c in by]
    spine = [named(c) for c in order]
    xs = [named(c) for c in exog]
    past = history.select(*keys, *spine, named(y), *xs).na.drop(subset=[y, *exog])
    ahead = future.select(*keys, *spine, F.lit(None).cast("double").alias(y), *xs)
    both = past.withColumn("__future", F.lit(False)).unionByName(
        ahead.withColumn("__future", F.lit(True))
    )
    known = join_series(both, model.drop("log"), by, order)
    flat = _stationary(known, y, exog, m, by, order)
    h = orders.long_ar
    lagged = _with_lags(flat, {"__z": range(1, h + 1)}, by, order)
    residual = F.col("__z") - dot(F.col("ar_beta"), F.array(*_long_ar_design(h, exog)))
    lagged = lagged.withColumn("__e", residual)
    reach = max([*orders.y_lags, *orders.e_lags, m + 1])

    def build(w: WindowSpec, position: Column, total: Column) -> dict[str, Column]:
        return {"__left": total - position}

    # Rows from the end of the history: total rows minus position minus the future rows.
    counted = over_rows(lagged, by, order, 0, build)
    horizon = ahead.groupBy(*keys).agg(F.count(F.lit(1)).alias("__horizon"))
    needed = counted.join(horizon, list(by)).filter(
        F.col("__future") | (F.col("__left") - F.col("__horizon") < reach)
    )
    x_array = F.array(*[F.col(f"__x{i}") for i in range(len(exog))]).cast("array<double>")
    item = F.struct(
        *spine,
        (named(y) / F.col("y_scale")).alias("y"),
        F.col("__z").alias("z"),
        F.col("__e").alias("e"),
        x_array.alias("x"),
    )
    gathered = needed.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(~F.col("__future"), item))).alias("past"),
        F.array_sort(F.collect_list(F.when(F.col("__future"), item))).alias("ahead"),
        *[F.first(c).alias(c) for c in ("beta", "y_scale", "seasonal_d")],
    )

    plain = 1 + len(orders.y_lags) + len(orders.e_lags)

    def back(values: Column, i: int) -> Column:
        return F.try_element_at(values, F.lit(-i))

    def share(weight: Column, value: Column) -> Column:
        """A term of the forecast: missing if its value is, unless the model leaves it out."""
        return F.when(weight == 0, F.lit(0.0)).otherwise(weight * value)

    def step(state: Column, row: Column) -> Column:
        zs, es, ys = state.getField("z"), state.getField("e"), state.getField("y")
        beta = F.col("beta")
        z = F.get(beta, F.lit(0))
        for i, lag in enumerate(orders.y_lags, 1):
            z = z + share(F.get(beta, F.lit(i)), back(zs, lag))
        for i, lag in enumerate(orders.e_lags, 1 + len(orders.y_lags)):
            z = z + share(F.get(beta, F.lit(i)), back(es, lag))
        for i in range(len(exog)):
            z = z + share(F.get(beta, F.lit(plain + i)), F.get(row.getField("x"), F.lit(i)))
        level = z + back(ys, 1)
        if m > 1:
            level = level + share(F.col("seasonal_d"), back(ys, m) - back(ys, m + 1))
        return F.struct(
            F.concat(zs, F.array(z)).alias("z"),
            F.concat(es, F.array(F.lit(0.0))).alias("e"),
            F.concat(ys, F.array(level)).alias("y"),
        )

    def series(name: str) -> Column:
        return F.transform(F.col("past"), lambda r: r.getField(name))

    start = F.struct(*[series(n).alias(n) for n in ("z", "e", "y")])
    path = F.aggregate(F.col("ahead"), start, step, lambda s: s.getField("y"))
    predicted = F.slice(path, F.size("past") + 1, F.size("ahead"))
    paths = (
        gathered.withColumn("__path", predicted)
        .select(*keys, "y_scale", F.inline(F.arrays_zip("ahead", "__path")))
        .select(
            *keys,
            *[F.col("ahead").getField(c).alias(c) for c in order],
            (F.col("__path") * F.col("y_scale")).alias("yhat"),
            F.lit(True).alias("__modelled"),
        )
    )
    reason = F.when(F.col("yhat").isNull(), F.when(F.col("__modelled"), "missing input").otherwise("no model"))
    return (
        ahead.select(*keys, *spine)
        .join(paths, [*by, *order], "left")
        .withColumn("reason", reason)
        .drop("__modelled")
    )
