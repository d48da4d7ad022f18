"""Screening of features before a model: univariate tests, shared information, inflation of variances.

All of it comes from sums and counts in one or two passes; tables of results have one row per feature.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.expressions import correlation, f_tail, missing_to_null, named
from panelcast.operators.quantiles import exact_quantiles
from panelcast.operators.shape import select_ranked
from panelcast.operators.stats import correlations

SINGULAR = 1e-9  # eigenvalue of a correlation matrix that counts as 0
SHARE = 1e-6  # weight of a column in such a direction that counts as none


def f_regression(
    df: DataFrame, features: Sequence[str], y: str = "y", by: Sequence[str] = ()
) -> DataFrame:
    """(by, feature, n, r, f, p): the F test of a regression of ``y`` on each feature alone.

    A feature uses the rows where it and the target are present. F is r^2 (n - 2) / (1 - r^2) and p the
    probability of a larger value by chance. A constant feature or target, and fewer than three rows, give
    NULLs; a perfect fit an infinite F and p = 0.
    """
    target, aggs, entries = missing_to_null(named(y)), [], []
    for i, c in enumerate(features):
        value = missing_to_null(named(c))
        aggs += [correlation(value, target).alias(f"r_{i}"), F.count(value + target).alias(f"n_{i}")]
        r = named(f"r_{i}").alias("r")
        entries.append(F.struct(F.lit(c).alias("feature"), named(f"n_{i}").alias("n"), r))
    keys = [named(c) for c in by]
    tested = df.groupBy(*keys).agg(*aggs).select(*keys, F.inline(F.array(*entries)))
    free = (F.col("n") - 2).cast("double")
    square = F.col("r") * F.col("r")
    perfect = square >= 1.0 - 1e-14
    f = F.when(perfect, F.lit(float("inf"))).otherwise(square / F.nullif(1 - square, F.lit(0.0)) * free)
    p = F.when(perfect, F.lit(0.0)).otherwise(f_tail(F.col("f"), F.lit(1.0), free))
    usable = (F.col("n") > 2) & F.col("r").isNotNull()
    return tested.withColumn("f", F.when(usable, f)).withColumn("p", F.when(usable, p))


def select_k_best(
    df: DataFrame, features: Sequence[str], k: int, keep: Sequence[str], y: str = "y"
) -> DataFrame:
    """``keep`` and the ``k`` features with the largest F, best first; ties by name."""
    tests = f_regression(df, features, y)
    ranking = tests.filter("f is not null").select(
        F.col("feature").alias("attribute"), F.col("f").alias("importance")
    )
    return select_ranked(df, ranking, k, keep)


def inflation_factors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, vif): the diagonal of the inverse of the features' correlation matrix.

    A correlation uses the rows where both features are present. A feature that others determine has an infinite factor;
    those that take no part in such a dependence keep theirs. A constant feature has NULL. The
    pairs come from block-wise aggregations; one row with a number per pair is solved. Which columns are
    constant is found when the operator is called.
    """
    k = len(features)

    @F.pandas_udf("array<struct<feature:string, vif:double>>")
    def factors(rows: pd.Series, constants: pd.Series) -> pd.Series:
        out = []
        for pairs, constant in zip(rows, constants):
            c = np.eye(k)
            for p in pairs:
                c[p["i"], p["j"]] = c[p["j"], p["i"]] = p["corr"]
            known = np.setdiff1d(np.arange(k), np.array(constant, int))
            values, vectors = np.linalg.eigh(c[np.ix_(known, known)])
            null = values < SINGULAR * max(len(known), 1)
            inverse = (vectors[:, ~null] ** 2 / values[~null]).sum(axis=1) if len(known) else []
            tied = (vectors[:, null] ** 2).sum(axis=1) > SHARE if len(known) else []
            result: list = [None] * k
            for at, v, t in zip(known, inverse, tied):
                result[at] = float("inf") if t else float(v)
            out.append([{"feature": f, "vif": v} for f, v in zip(features, result)])
        return pd.Series(out)

    spread = [F.coalesce(F.var_pop(missing_to_null(named(c))), F.lit(0.0)) > 0 for c in features]
    varies = list(df.agg(*spread).first())  # a constant column has no correlation
    known = [i for i, v in enumerate(varies) if v]
    found = correlations(df, [features[i] for i in known])
    place = F.array(*[F.lit(i) for i in known])
    pair = F.struct(F.get(place, F.col("i")).alias("i"), F.get(place, F.col("j")).alias("j"), "corr")
    constant = F.lit([i for i, v in enumerate(varies) if not v]).cast("array<int>")
    return found.agg(F.collect_list(pair).alias("pairs")).select(F.inline(factors("pairs", constant)))


def quantile_edges(df: DataFrame, cols: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Inner edges that cut each column into ``bins`` parts of like size, from exact quantiles.

    At most ``bins - 1`` numbers per column reach the driver. Equal edges count once.
    """
    entries = [F.struct(F.lit(c).alias("feature"), missing_to_null(named(c)).alias("value")) for c in cols]
    long = df.select(F.inline(F.array(*entries)))
    probs = [i / bins for i in range(1, bins)]
    found = exact_quantiles(long, "value", probs, ["feature"], interpolate=False)
    edges: dict[str, set[float]] = {c: set() for c in cols}
    for r in found.collect():
        edges[r["feature"]].add(r["value"])
    return {c: sorted(v) for c, v in edges.items()}


def mutual_information(
    df: DataFrame,
    features: Sequence[str],
    y: str = "y",
    bins: int = 8,
    edges: Mapping[str, Sequence[float]] | None = None,
) -> DataFrame:
    """(feature, n, mi, mi_corrected): information, in nats, that a feature's bin and the target's bin share.

    ``edges`` gives the inner edges of columns, a value on an edge falls below it; the other columns are cut
    at exact quantiles. A feature uses the rows where it and the target are present. ``mi_corrected`` takes off the
    bias of the counts (Miller and Madow 1955), so independent columns are near 0, above or below.
    The counts of all features come from one pass.
    """
    cols = [*features, y]
    known = dict(edges or {})
    missing = [c for c in cols if c not in known]
    if missing:
        known |= quantile_edges(df, missing, bins)

    def number(c: str) -> Column:
        value = missing_to_null(named(c))
        above = F.lit(0)
        for e in known[c]:
            above = above + (value > F.lit(float(e))).cast("int")
        return F.when(value.isNotNull(), above)

    entries = [F.struct(F.lit(c).alias("feature"), number(c).alias("i")) for c in features]
    cells = (
        df.select(number(y).alias("j"), F.inline(F.array(*entries)))
        .filter("i is not null and j is not null")
        .groupBy("feature", "i", "j")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    whole = Window.partitionBy("feature")  # one row per pair of bins
    margins = cells.withColumns(
        {
            "total": F.sum("n").over(whole),
            "row": F.sum("n").over(Window.partitionBy("feature", "i")),
            "col": F.sum("n").over(Window.partitionBy("feature", "j")),
        }
    )
    share = F.col("n") / F.col("total")
    shared = F.sum(share * F.ln(F.col("n") * F.col("total") / (F.col("row") * F.col("col"))))
    found = margins.groupBy("feature").agg(
        F.max("total").cast("bigint").alias("n"),
        shared.alias("mi"),
        (F.countDistinct("i") + F.countDistinct("j") - F.count(F.lit(1)) - 1).alias("__bias"),
    )
    return found.select(
        "feature", "n", "mi", (F.col("mi") + F.col("__bias") / (2.0 * F.col("n"))).alias("mi_corrected")
    )
