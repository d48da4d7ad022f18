"""Least squares for many series at once.

The data rows are reduced to sums of products per group (the Gram matrix of the design), a plain
aggregation with partial sums in every task. What leaves the aggregation has a size fixed by the
number of columns, whatever the length of a series. The only Python step solves those small
matrices, a batch of groups at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.expressions import named

NATIVE_COLUMNS = 40


def gram_columns(names: Sequence[str]) -> Column:
    """Upper triangle of the sums of products, row by row, as one array of aggregates.

    Written as one SQL expression: hundreds of single column objects would take longer to build
    than the query takes to run.
    """
    sums = [f"sum({a} * {b})" for i, a in enumerate(names) for b in names[i:]]
    return F.expr(f"array({', '.join(sums)})")


def gram(
    df: DataFrame,
    by: Sequence[str],
    terms: Sequence[Column],
    extra: Sequence[Column] = (),
) -> DataFrame:
    """(by, n, gram, extra) with the sums over all rows of a group; terms must not be NULL.

    Beyond ``NATIVE_COLUMNS`` terms the number of single sums would swamp the generated code, so
    each task forms partial matrices from Arrow batches and their entries are summed by position.
    That pays when rows of a group lie together, as they do behind ``over_rows``.
    ``extra`` holds further aggregates; the wide path computes them by an aggregation of their own.
    """
    keys = [named(c) for c in by]
    if len(terms) <= NATIVE_COLUMNS:
        names = [f"__t{i}" for i in range(len(terms))]
        named_terms = df.select("*", *[t.cast("double").alias(n) for t, n in zip(terms, names)])
        return named_terms.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), gram_columns(names).alias("gram"), *extra
        )
    rows = df.select(*keys, F.array(*[t.cast("double") for t in terms]).alias("__x"))
    sums = _wide_gram(rows, by, len(terms))
    if not extra:
        return sums
    return sums.join(df.groupBy(*keys).agg(*extra), list(by))


def _wide_gram(rows: DataFrame, by: Sequence[str], width: int) -> DataFrame:
    key_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(
        *[named(c) for c in by]
    ).schema)

    def partial(batches: Iterator) -> Iterator:
        upper = np.triu_indices(width)
        for batch in batches:
            out = []
            for key, part in batch.groupby(list(by), sort=False):
                x = np.vstack(part["__x"].to_numpy())
                values = (x.T @ x)[upper]
                out.append([*key, len(part), values])
            yield pd.DataFrame(out, columns=[*by, "__n", "__g"])

    partials = rows.mapInPandas(partial, f"{key_fields}, __n bigint, __g array<double>")
    keys = [named(c) for c in by]
    entries = partials.select(
        *keys, F.posexplode(F.concat(F.array(F.col("__n").cast("double")), "__g"))
    )
    totals = entries.groupBy(*keys, "pos").agg(F.sum("col").alias("value"))
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda e: e.getField("value")
    )
    packed = totals.groupBy(*keys).agg(ordered.alias("__all"))
    return packed.select(
        *keys,
        F.element_at("__all", 1).cast("bigint").alias("n"),
        F.slice("__all", 2, width * (width + 1) // 2).alias("gram"),
    )


FIT_TYPE = "struct<n:bigint, k:int, sse:double, aic:double, beta:array<double>, se:array<double>>"


def ols(width: int):
    """Column function (n, gram) -> fit of the last design column on all others.

    ``beta`` and ``se`` follow the order of the design. A singular design gets the shortest
    solution (pseudo-inverse).
    """

    @F.pandas_udf(FIT_TYPE)
    def fit(n: pd.Series, gram_values: pd.Series) -> pd.DataFrame:
        g = np.zeros((len(gram_values), width, width))
        upper = np.triu_indices(width)
        if len(gram_values):
            g[:, upper[0], upper[1]] = np.vstack(gram_values.to_numpy())
            g[:, upper[1], upper[0]] = g[:, upper[0], upper[1]]
        k = width - 1
        size = np.sqrt(np.maximum(np.einsum("bii->bi", g), 1e-300))[:, :k]
        xx = g[:, :k, :k] / size[:, :, None] / size[:, None, :]
        inverse = np.linalg.pinv(xx, rcond=1e-12, hermitian=True)
        rank = np.round(np.einsum("bij,bji->b", inverse, xx))
        beta = np.einsum("bij,bj->bi", inverse, g[:, :k, k] / size) / size
        sse = np.maximum(g[:, k, k] - np.einsum("bi,bi->b", beta, g[:, :k, k]), 0.0)
        count = n.to_numpy(dtype=float)
        with np.errstate(divide="ignore", invalid="ignore"):
            aic = count * np.log(sse / count) + 2 * rank
            spread = np.sqrt(
                np.maximum(sse / (count - rank), 0.0)[:, None] * np.einsum("bii->bi", inverse)
            )
        se = spread / size
        return pd.DataFrame(
            {
                "n": n,
                "k": rank.astype("int32"),
                "sse": sse,
                "aic": aic,
                "beta": list(beta),
                "se": list(se),
            }
        )

    return fit
