"""Unit-root tests of every series in one job."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from panelcast.functions.expressions import named, normal_cdf
from panelcast.operators.gram import gram
from panelcast.operators.ordered import difference, join_series, over_rows

# Response surface of MacKinnon (1994) for one series. Polynomials in rising powers,
# the left one up to `split`; outside [low, high] the p-value is 0 or 1.
RESPONSE = {
    "c": {
        "low": -18.83,
        "split": -1.61,
        "high": 2.74,
        "left": (2.1659, 1.4412, 0.038269),
        "right": (1.7339, 0.93202, -0.12745, -0.010368),
    },
    "ct": {
        "low": -16.18,
        "split": -2.89,
        "high": 0.70,
        "left": (3.2512, 1.6047, 0.049588),
        "right": (2.5261, 0.61654, -0.37956, -0.060285),
    },
}


def _polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    total = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        total = total * x + F.lit(c)
    return total


def unit_root_p_value(statistic: Column, regression: str = "c") -> Column:
    """p-value of a Dickey-Fuller statistic under the unit-root hypothesis."""
    r = RESPONSE[regression]
    z = F.when(statistic <= r["split"], _polynomial(statistic, r["left"])).otherwise(
        _polynomial(statistic, r["right"])
    )
    return (
        F.when(statistic > r["high"], 1.0).when(statistic < r["low"], 0.0).otherwise(normal_cdf(z))
    )


def df_test(
    panel: DataFrame,
    y: str = "y",
    by: Sequence[str] = ("series_id",),
    order: Sequence[str] = ("ds",),
    alpha: float = 0.05,
) -> DataFrame:
    """Dickey-Fuller test with a constant and no lagged differences: closed form, all native."""
    steps = difference(panel, y, 1, by, order, "__dy")
    steps = steps.withColumn("__y1", named(y) - F.col("__dy")).filter("__dy is not null")
    sums = steps.groupBy(*[named(c) for c in by]).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.regr_slope("__dy", "__y1").alias("slope"),
        F.regr_sxx("__dy", "__y1").alias("sxx"),
        F.regr_syy("__dy", "__y1").alias("syy"),
        F.regr_sxy("__dy", "__y1").alias("sxy"),
    )
    sse = F.col("syy") - F.col("slope") * F.col("sxy")
    se = F.sqrt(sse / F.nullif(F.col("n_obs") - 2, F.lit(0)) / F.nullif(F.col("sxx"), F.lit(0.0)))
    tested = sums.withColumn("statistic", F.col("slope") / F.nullif(se, F.lit(0.0)))
    return tested.select(
        *[named(c) for c in by],
        "statistic",
        unit_root_p_value(F.col("statistic"), "c").alias("p_value"),
        F.lit(0).alias("used_lag"),
        "n_obs",
        (unit_root_p_value(F.col("statistic"), "c") <= alpha).alias("stationary"),
    )


def _augmented(width: int, deterministic: int, choose: bool):
    """Column function (series length, longest lag, n, gram, first values) -> test result.

    Design columns: constant, (trend), level, lagged differences 1..width, difference. The Gram
    matrix covers the rows on which the longest lag exists; the first values of the series restore
    the few earlier rows that a shorter lag can use as well.
    """

    @F.pandas_udf("struct<statistic:double, used_lag:int, n_obs:bigint>")
    def solve(
        length: pd.Series, longest: pd.Series, n: pd.Series, grams: pd.Series, heads: pd.Series
    ) -> pd.DataFrame:
        batch = len(length)
        size = deterministic + 2 + width
        fixed = deterministic + 1
        g = np.zeros((batch, size, size))
        upper = np.triu_indices(size)
        if batch:
            g[:, upper[0], upper[1]] = np.vstack(grams.to_numpy())
            g[:, upper[1], upper[0]] = g[:, upper[0], upper[1]]
        total = length.to_numpy(dtype=float)
        top = longest.to_numpy(dtype=int)
        rows = n.to_numpy(dtype=float)

        def regress(m, k):
            scale = np.sqrt(np.maximum(np.einsum("bii->bi", m)[:, :k], 1e-300))
            xx = m[:, :k, :k] / scale[:, :, None] / scale[:, None, :]
            inverse = np.linalg.pinv(xx, rcond=1e-13, hermitian=True)
            beta = np.einsum("bij,bj->bi", inverse, m[:, :k, -1] / scale) / scale
            sse = m[:, -1, -1] - np.einsum("bi,bi->b", beta, m[:, :k, -1])
            variance = np.einsum("bii->bi", inverse) / scale**2
            return beta, np.maximum(sse, 0.0), variance

        with np.errstate(divide="ignore", invalid="ignore"):
            if choose:
                scores = np.full((batch, width + 1), np.inf)
                for lag in range(width + 1):
                    _, sse, _ = regress(g, fixed + lag)
                    aic = rows * np.log(sse / rows) + 2 * (fixed + lag)
                    usable = (lag <= top) & (rows > fixed + lag) & np.isfinite(aic)
                    scores[:, lag] = np.where(usable, aic, np.inf)
                used = scores.argmin(axis=1)
            else:
                used = np.maximum(top, 0)

            first = np.full((batch, width + 1), np.nan)
            for b, head in enumerate(heads):
                first[b, : len(head)] = head[: width + 1]
            for position in range(2, width + 2):
                use = (position >= used + 2) & (position <= top + 1)
                x = np.zeros((batch, size))
                x[:, 0] = 1.0
                if deterministic == 2:
                    x[:, 1] = position / total
                x[:, deterministic] = first[:, position - 2]
                for lag in range(1, position - 1):
                    x[:, fixed + lag - 1] = (
                        first[:, position - 1 - lag] - first[:, position - 2 - lag]
                    )
                x[:, -1] = first[:, position - 1] - first[:, position - 2]
                x = np.where(use[:, None], x, 0.0)
                g += x[:, :, None] * x[:, None, :]

            statistic = np.full(batch, np.nan)
            observed = total - 1 - used
            for lag in np.unique(used):
                chosen = np.flatnonzero(used == lag)
                k = fixed + lag
                beta, sse, variance = regress(g[chosen], k)
                se = np.sqrt(sse / (observed[chosen] - k) * variance[:, deterministic])
                statistic[chosen] = beta[:, deterministic] / se
        bad = ~np.isfinite(statistic) | (top < 0)
        return pd.DataFrame(
            {
                "statistic": pd.Series(np.where(bad, np.nan, statistic)),
                "used_lag": used.astype("int32"),
                "n_obs": observed.astype("int64"),
            }
        )

    return solve


def longest_series(panel: DataFrame, by: Sequence[str]) -> int:
    """Row count of the longest series: one number from one partial aggregation."""
    counts = panel.groupBy(*[named(c) for c in by]).count()
    return counts.agg(F.max("count")).first()[0] or 0


def adf_test(
    panel: DataFrame,
    y: str = "y",
    by: Sequence[str] = ("series_id",),
    order: Sequence[str] = ("ds",),
    max_lag: int | None = None,
    regression: str = "c",
    rule: str = "aic",
    alpha: float = 0.05,
) -> DataFrame:
    """Augmented Dickey-Fuller test per series: statistic, p-value, lag, observations, verdict.

    ``rule='aic'`` picks the number of lagged differences up to ``ceil(12 (n/100)^0.25)`` on the
    common sample and refits on the longest one; ``rule='cube_root'`` takes ``trunc((n-1)^(1/3))``.
    ``max_lag`` replaces the rule's upper bound. Without it, one job finds the longest series to
    know how many lag columns are needed.
    """
    deterministic = {"c": 1, "ct": 2}[regression]

    def rule_lag(n: Column) -> Column:
        if rule == "cube_root":
            return F.floor(F.pow(n - 1, F.lit(1.0 / 3.0)) + 1e-9)
        return F.ceil(F.lit(12.0) * F.pow(n / F.lit(100.0), F.lit(0.25)))

    if max_lag is None:
        n = longest_series(panel, by)
        width = int((n - 1) ** (1 / 3) + 1e-9) if rule == "cube_root" else int(
            np.ceil(12.0 * (n / 100.0) ** 0.25)
        )
    else:
        width = max_lag
    keys = [named(c) for c in by]
    clean = panel.select(*keys, *[named(c) for c in order], named(y).alias("__y")).filter(
        "__y is not null"
    )
    n = F.count(F.lit(1))
    stats = clean.groupBy(*keys).agg(
        n.alias("__n"),
        F.avg("__y").alias("__mean"),
        F.stddev_pop("__y").alias("__sd"),
    )
    bound = F.lit(max_lag) if max_lag is not None and rule == "aic" else rule_lag(F.col("__n"))
    stats = stats.withColumn(
        "__top",
        F.least(bound, F.floor(F.col("__n") / 2) - deterministic - 1, F.lit(width)).cast("int"),
    )
    scaled = join_series(clean, stats, by, order).withColumn(
        "__z", (F.col("__y") - F.col("__mean")) / F.nullif(F.col("__sd"), F.lit(0.0))
    )

    def build(w: WindowSpec, position: Column, total: Column) -> dict[str, Column]:
        new = {"__pos": position}
        for i in range(width + 2):
            new[f"__l{i}"] = F.lag("__z", i).over(w) if i else F.col("__z")
        return new

    lagged = over_rows(scaled, by, order, width + 1, build)
    common = (F.col("__pos") > F.col("__top") + 1) & F.col("__z").isNotNull()
    design = [F.lit(1.0)]
    if deterministic == 2:
        design.append(F.col("__pos") / F.col("__n"))
    design.append(F.col("__l1"))
    for i in range(1, width + 1):
        design.append(F.when(F.col("__top") >= i, F.col(f"__l{i}") - F.col(f"__l{i + 1}")))
    design.append(F.col("__l0") - F.col("__l1"))
    terms = [F.coalesce(F.when(common, c), F.lit(0.0)) for c in design]
    head = F.when(F.col("__pos") <= width + 1, F.struct("__pos", "__z"))
    sums = gram(
        lagged,
        by,
        terms,
        [
            F.first("__n").alias("__n"),
            F.first("__top").alias("__top"),
            F.sum(common.cast("bigint")).alias("__rows"),
            F.transform(
                F.array_sort(F.collect_list(head)), lambda e: e.getField("__z")
            ).alias("__head"),
        ],
    )
    solve = _augmented(width, deterministic, rule == "aic")
    tested = sums.select(
        *keys, solve("__n", "__top", "__rows", "gram", "__head").alias("__r")
    ).select(*keys, "__r.*")
    statistic = F.nanvl("statistic", F.lit(None).cast("double"))
    p = unit_root_p_value(F.col("statistic"), regression)
    return (
        tested.withColumn("statistic", statistic)
        .withColumn("p_value", F.when(F.col("statistic").isNotNull(), p))
        .select(
            *keys,
            "statistic",
            "p_value",
            "used_lag",
            "n_obs",
            (F.col("p_value") <= alpha).alias("stationary"),
        )
    )


def should_diff(
    panel: DataFrame,
    y: str = "y",
    by: Sequence[str] = ("series_id",),
    order: Sequence[str] = ("ds",),
    alpha: float = 0.05,
) -> DataFrame:
    """Whether a series needs differencing: the test with trend does not reject a unit root."""
    tested = adf_test(panel, y, by, order, regression="ct", rule="cube_root", alpha=alpha)
    return tested.select(
        *[named(c) for c in by], "statistic", "p_value", (F.col("p_value") > alpha).alias("diff")
    )
