"""Column statistics, scaling, filling and correlation pruning.

Statistics are plain aggregates: every task reduces its rows to one row per group before the
shuffle, so a group holding most rows costs no more than any other. They come back to the data
rows as a scalar subquery (whole table) or a join on the group key that depends on their measured
size, never as a window over whole groups. With ``by`` the statistics are computed when the operator
is called; the data rows stay lazy.
"""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.expressions import missing_to_null, named
from panelcast.operators.lineage import attach_facts

PAIR_BLOCK = 28  # columns of a block; the pairs of two blocks share one aggregation


def column_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Minimum and maximum of every column in one pass, as rows (group, feature, min, max)."""
    aggs = []
    for i, c in enumerate(cols):
        value = missing_to_null(named(c))
        aggs += [F.min(value).alias(f"lo_{i}"), F.max(value).alias(f"hi_{i}")]
    groups = [named(c) for c in by]
    wide = df.groupBy(*groups).agg(*aggs)
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                named(f"lo_{i}").alias("min_value"),
                named(f"hi_{i}").alias("max_value"),
            )
            for i, c in enumerate(cols)
        ]
    )
    return wide.select(*groups, F.inline(entries))


def with_stats(
    df: DataFrame, stats: dict[str, Column], by: Sequence[str], build, fit_on: DataFrame | None
) -> DataFrame:
    """Project ``build(get)`` where ``get(name)`` is the statistic of the row's group.

    ``fit_on`` gives the rows to compute statistics from, for instance the training rows only.
    """
    source = df if fit_on is None else fit_on
    packed = F.struct(*[c.alias(n) for n, c in stats.items()]).alias("__stats")
    if by:
        per_group = source.groupBy(*[named(c) for c in by]).agg(packed)
        known = attach_facts(df, per_group, by)
    else:
        # One row, computed once; a column of its own so that it is planned once as well.
        known = df.withColumn("__stats", source.agg(packed).scalar())
    return known.select(*build(lambda name: F.col("__stats").getField(name)))


def _replace(df: DataFrame, new: dict[str, Column]) -> list[Column]:
    return [new[c].alias(c) if c in new else named(c) for c in df.columns]


def minmax_scale(
    df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), fit_on: DataFrame | None = None
) -> DataFrame:
    """Scale columns into [0, 1]; a constant column becomes 0 and a missing value stays missing."""
    stats = {}
    for i, c in enumerate(cols):
        stats[f"lo_{i}"] = F.min(missing_to_null(named(c)))
        stats[f"hi_{i}"] = F.max(missing_to_null(named(c)))

    def build(get):
        new = {}
        for i, c in enumerate(cols):
            lo, hi, value = get(f"lo_{i}"), get(f"hi_{i}"), missing_to_null(named(c))
            # 0 * x keeps NULL for a missing value of a constant column.
            new[c] = F.when(hi == lo, value * 0.0).otherwise(
                (value - lo) / F.nullif(hi - lo, F.lit(0.0))
            )
        return _replace(df, new)

    return with_stats(df, stats, by, build, fit_on)


def standardize(
    df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), fit_on: DataFrame | None = None
) -> DataFrame:
    """Centre and divide by the population deviation; a constant column becomes 0."""
    stats = {}
    for i, c in enumerate(cols):
        stats[f"mu_{i}"] = F.avg(missing_to_null(named(c)))
        stats[f"sd_{i}"] = F.stddev_pop(missing_to_null(named(c)))

    def build(get):
        new = {}
        for i, c in enumerate(cols):
            sd = get(f"sd_{i}")
            centred = missing_to_null(named(c)) - get(f"mu_{i}")
            new[c] = F.when(sd == 0, centred).otherwise(centred / F.nullif(sd, F.lit(0.0)))
        return _replace(df, new)

    return with_stats(df, stats, by, build, fit_on)


def fill_with_mean_of(
    df: DataFrame, cols: Sequence[str], of: str, by: Sequence[str] = ()
) -> DataFrame:
    """Fill missing values of every listed column with the mean of the one column ``of``."""
    return with_stats(
        df,
        {"mean": F.avg(missing_to_null(named(of)))},
        by,
        lambda get: _replace(
            df, {c: F.coalesce(missing_to_null(named(c)), get("mean")) for c in cols}
        ),
        None,
    )


def fill_own_mean(
    df: DataFrame,
    cols: Sequence[str],
    by: Sequence[str] = (),
    fit_on: DataFrame | None = None,
    flag: bool = False,
) -> DataFrame:
    """Fill each column with its own mean; ``flag`` adds a 0/1 column per filled column."""
    stats = {f"mean_{i}": F.avg(missing_to_null(named(c))) for i, c in enumerate(cols)}

    def build(get):
        filled = _replace(
            df,
            {
                c: F.coalesce(missing_to_null(named(c)), get(f"mean_{i}"))
                for i, c in enumerate(cols)
            },
        )
        if flag:
            filled += [
                missing_to_null(named(c)).isNull().cast("double").alias(f"{c}_missing")
                for c in cols
            ]
        return filled

    return with_stats(df, stats, by, build, fit_on)


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair j < i, as rows (i, j, column, earlier, corr).

    Each pair uses the rows where both values are present, whatever the number of columns. The pairs
    of two blocks of columns share one native aggregation, which reads these columns only.
    """
    starts = range(0, len(cols), PAIR_BLOCK)
    blocks = [(p, q) for p in starts for q in starts if q <= p]

    def block(p: int, q: int) -> DataFrame | None:
        pairs = [
            (i, j)
            for i in range(p, min(p + PAIR_BLOCK, len(cols)))
            for j in range(q, min(q + PAIR_BLOCK, i))
        ]
        if not pairs:
            return None
        value = {i: missing_to_null(named(cols[i])) for pair in pairs for i in pair}
        wide = df.agg(*[F.corr(value[i], value[j]).alias(f"r_{i}_{j}") for i, j in pairs])
        entries = [
            F.struct(
                F.lit(i).alias("i"),
                F.lit(j).alias("j"),
                F.lit(cols[i]).alias("column"),
                F.lit(cols[j]).alias("earlier"),
                named(f"r_{i}_{j}").alias("corr"),
            )
            for i, j in pairs
        ]
        return wide.select(F.inline(F.array(*entries)))

    parts = [part for p, q in blocks if (part := block(p, q)) is not None]
    if not parts:
        return df.sparkSession.createDataFrame(
            [], "i int, j int, column string, earlier string, corr double"
        )
    return reduce(lambda x, y: x.unionByName(y), parts)


def correlated_columns(
    df: DataFrame, cols: Sequence[str], threshold: float = 0.8, absolute: bool = False
) -> DataFrame:
    """Columns correlated above the threshold with any earlier column of the list.

    By default the sign counts, so a strong negative correlation does not flag a column.
    """
    pairs = correlations(df, cols)
    strength = F.abs("corr") if absolute else F.col("corr")
    return pairs.filter(strength > threshold).select("column").distinct()
