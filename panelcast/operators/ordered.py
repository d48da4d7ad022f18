"""Operators over the row order inside a series.

How the rows of a series are spread decides whether these scale:

* The order is one DATE column. (series, ds) is unique, so the calendar bounds a series at 366 rows a
  year.
  A window partitioned by series is then bounded too, and costs one shuffle.
* Anything else: a timestamp, a DATE with a column that breaks ties, a whole table. One series
  may hold any share of all rows. The series is cut into chunks
  of its order; each chunk receives the few rows before it that a trailing frame can reach, the few after
  it where a frame looks ahead, and a header with the number of rows before it. The window is partitioned by (series, chunk), so the
  rows still cross one shuffle and no task holds a whole series. Results are the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.expressions import missing_to_null, named
from panelcast.operators.lineage import attach_facts

_HEADER, _HALO, _ROW, _AHEAD = 0, 1, 2, 3
SAMPLE_PER_CHUNK = 100
SAMPLE_LIMIT = 1_000_000
Build = Callable[[WindowSpec, Column, Column], dict[str, Column]]


def calendar_bounded(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> bool:
    """True when a series is ordered by one DATE column alone, which bounds its rows.

    With a second order column many rows may share a date, and without a group key the whole table
    would be one series.
    """
    return bool(by) and len(order) == 1 and isinstance(df.schema[order[0]].dataType, T.DateType)


def join_series(
    df: DataFrame, facts: DataFrame, by: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Join one row per series ahead of a window over the rows of a series.

    On a DATE panel the join lays the rows out by series, which the window needs anyway. Else the
    rows are not gathered by series at all.
    """
    if calendar_bounded(df, by, order):
        return df.join(facts, list(by))
    return attach_facts(df, facts, by, "inner")


def even_chunks(df: DataFrame, col: str, chunks: int | None = None, seed: int = 17) -> DataFrame:
    """Append ``__chunk``, the number of the chunk a timestamp falls into.

    Bounds are quantiles of a sample of the one column, as in a range partitioning: a hundred
    values per chunk, at most a million. An uneven calendar (a burst in one hour) still gives
    chunks of like size, and no row is lost, because only the bounds depend on the sample. They
    are constants of the plan: a recomputed task gives its rows the same chunk as before. The
    number of chunks follows ``spark.sql.shuffle.partitions``.
    """
    if chunks is None:
        chunks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    micros = F.unix_micros(named(col).cast("timestamp")).cast("double")
    times = df.select(micros.alias("t"))
    wanted = min(SAMPLE_PER_CHUNK * chunks, SAMPLE_LIMIT)
    rows = times.count()
    sample = times if rows <= wanted else times.sample(wanted / rows, seed)
    values = np.sort(sample.toPandas()["t"].to_numpy(dtype=float))
    cuts = np.unique(values[np.arange(1, chunks) * len(values) // chunks]) if len(values) else []
    splits = [-math.inf, *map(float, cuts), math.inf]
    numbered = df.withColumn("__micros", micros)
    bucketizer = Bucketizer(splits=splits, inputCol="__micros", outputCol="__chunk")
    return bucketizer.transform(numbered).drop("__micros")


def over_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    reach: int,
    build: Build,
    chunk: Column | None = None,
    ahead: int = 0,
) -> DataFrame:
    """Append columns computed over the ordered rows of each group.

    ``build(window, position, total)`` returns the new columns. ``window`` is ordered and may be
    used with ``lag`` up to ``reach`` rows, ``lead`` up to ``ahead`` rows and with frames of as many
    preceding and following rows; ``position`` is the 1-based row number in the group and ``total`` its row count. Group and
    order keys must not be NULL, and ``order`` must be unique within a group.
    ``chunk`` is any expression that never decreases along the order.
    """
    groups = [named(c) for c in by]
    ordering = [named(c) for c in order]
    if chunk is None and calendar_bounded(df, by, order):
        window = Window.partitionBy(*groups).orderBy(*ordering)
        whole = Window.partitionBy(*groups)
        made = build(window, F.row_number().over(window), F.count(F.lit(1)).over(whole))
        return df.select("*", *[c.alias(n) for n, c in made.items()])

    rows = even_chunks(df, order[0]) if chunk is None else df.withColumn("__chunk", chunk)
    in_group = Window.partitionBy(*groups)
    along = in_group.orderBy("__chunk")
    sizes = rows.groupBy(*groups, "__chunk").agg(F.count(F.lit(1)).alias("__rows"))
    index = sizes.select(
        *groups,
        "__chunk",
        "__rows",
        (F.sum("__rows").over(along) - F.col("__rows")).alias("__before"),
        F.sum("__rows").over(in_group).alias("__total"),
    )
    parts = rows.withColumn("__kind", F.lit(_ROW)).unionByName(
        index.drop("__rows").withColumn("__kind", F.lit(_HEADER)), allowMissingColumns=True
    )
    for steps, kind in ((reach, _HALO), (ahead, _AHEAD)):
        if steps:
            halo = _neighbours(rows, index, by, order, steps, kind)
            parts = parts.unionByName(halo, allowMissingColumns=True)
    window = Window.partitionBy(*groups, "__chunk").orderBy("__kind", *ordering)
    running = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    position = F.max("__before").over(running) + F.sum(
        F.when(F.col("__kind") == _ROW, 1).otherwise(0)
    ).over(running)
    made = build(window, position, F.max("__total").over(running))
    kept = parts.select("*", *[c.alias(n) for n, c in made.items()]).filter(
        F.col("__kind") == _ROW
    )
    return kept.select(*[named(c) for c in [*df.columns, *made]])


def _neighbours(
    rows: DataFrame, index: DataFrame, by: Sequence[str], order: Sequence[str], steps: int, kind: int
) -> DataFrame:
    """Copies of the rows within ``steps`` rows of another chunk, given to that chunk as ``kind``.

    ``_HALO`` copies the last rows of a chunk forwards, ``_AHEAD`` the first ones backwards. ``__gap`` rows
    lie between the two chunks.
    """
    groups = [named(c) for c in by]
    ordering = [named(c) for c in order]
    forwards = kind == _HALO
    nearest = [c.desc() for c in ordering] if forwards else ordering
    edge = Window.partitionBy(*groups, "__chunk").orderBy(*nearest)
    edges = rows.withColumn("__back", F.row_number().over(edge)).filter(F.col("__back") <= steps)
    end = F.col("__before") + F.col("__rows")
    along = Window.partitionBy(*groups).orderBy("__chunk")
    others = along.rowsBetween(1, steps) if forwards else along.rowsBetween(-steps, -1)
    seen = F.struct(
        F.col("__chunk").alias("target"), (F.col("__before") if forwards else end).alias("border")
    )
    near = index.withColumn("__near", F.collect_list(seen).over(others)).select(
        *groups, "__chunk", (end if forwards else F.col("__before")).alias("__own"), F.inline("__near")
    )
    near = near.select(
        *groups,
        "__chunk",
        F.col("target").alias("__target"),
        F.abs(F.col("border") - F.col("__own")).alias("__gap"),
    )
    return (
        edges.join(near.filter(F.col("__gap") < steps), [*by, "__chunk"])
        .filter(F.col("__back") + F.col("__gap") <= steps)
        .withColumn("__chunk", F.col("__target"))
        .withColumn("__kind", F.lit(kind))
        .drop("__target", "__gap", "__back")
    )


def rolling_mean(
    df: DataFrame,
    col: str,
    n: int,
    by: Sequence[str] = ("series_id",),
    order: Sequence[str] = ("ds",),
    name: str | None = None,
    chunk: Column | None = None,
) -> DataFrame:
    """Trailing mean of n rows; NULL until n rows exist and where one of them is missing."""

    def build(w: WindowSpec, position: Column, total: Column) -> dict[str, Column]:
        frame = w.rowsBetween(1 - n, 0)
        value = missing_to_null(named(col))
        full = F.count(value).over(frame) == n
        return {name or f"{col}_mean_{n}": F.when(full, F.avg(value).over(frame))}

    return over_rows(df, by, order, n - 1, build, chunk)


def difference(
    df: DataFrame,
    col: str,
    lag: int = 1,
    by: Sequence[str] = ("series_id",),
    order: Sequence[str] = ("ds",),
    name: str | None = None,
    chunk: Column | None = None,
) -> DataFrame:
    """Value minus the value ``lag`` rows earlier in the series."""

    def build(w: WindowSpec, position: Column, total: Column) -> dict[str, Column]:
        value = missing_to_null(named(col))
        return {name or f"{col}_diff_{lag}": value - F.lag(value, lag).over(w)}

    return over_rows(df, by, order, lag, build, chunk)


def lag_matrix(
    df: DataFrame,
    col: str,
    lags: Sequence[int],
    by: Sequence[str] = ("series_id",),
    order: Sequence[str] = ("ds",),
    chunk: Column | None = None,
) -> DataFrame:
    """Append ``<col>_lag_<i>`` for each lag, all from one sorted pass."""

    def build(w: WindowSpec, position: Column, total: Column) -> dict[str, Column]:
        return {f"{col}_lag_{i}": F.lag(named(col), i).over(w) for i in lags}

    return over_rows(df, by, order, max(lags), build, chunk)


def time_split(
    df: DataFrame,
    n_train: int | None = None,
    horizon: int | None = None,
    by: Sequence[str] = ("series_id",),
    order: Sequence[str] = ("ds",),
    chunk: Column | None = None,
) -> DataFrame:
    """Append ``split``: the first ``n_train`` rows of a series, or all but its last ``horizon``,
    are 'train' and the others 'test'."""
    if (n_train is None) == (horizon is None):
        raise ValueError("give n_train or horizon")

    def build(w: WindowSpec, position: Column, total: Column) -> dict[str, Column]:
        last = F.lit(n_train) if horizon is None else total - horizon
        return {"split": F.when(position <= last, "train").otherwise("test")}

    return over_rows(df, by, order, 0, build, chunk)


def three_way_split(
    df: DataFrame,
    validate: int,
    test: int,
    by: Sequence[str] = ("series_id",),
    order: Sequence[str] = ("ds",),
) -> DataFrame:
    """Append ``split``: last ``test`` rows 'test', the ``validate`` before them 'validate'."""

    def build(w: WindowSpec, position: Column, total: Column) -> dict[str, Column]:
        left = total - position
        return {
            "split": F.when(left < test, "test")
            .when(left < test + validate, "validate")
            .otherwise("train")
        }

    return over_rows(df, by, order, 0, build)


def fold_number(position: Column, total: Column, k: int) -> Column:
    """1-based fold of k contiguous folds; the first ``total mod k`` folds get one row more."""
    size = F.floor(total / F.lit(k))
    longer = total % k
    in_longer = longer * (size + 1)
    return (
        F.when(position <= in_longer, F.ceil(position / (size + 1)))
        .otherwise(longer + F.ceil((position - in_longer) / F.greatest(size, F.lit(1))))
        .cast("int")
    )


def time_folds(df: DataFrame, k: int, ds: str = "ds") -> DataFrame:
    """Append ``fold`` (1..k): contiguous folds over the distinct dates of a pooled table.

    A date is in one fold for all series. Only distinct dates are ordered, and only the k first
    dates of the folds go back to the data rows, as one small array: no join on a crowded date.
    """
    dates = df.select(named(ds)).distinct()
    # distinct dates of a year are few; moments are cut at sampled quantiles
    yearly = F.year(named(ds)) if isinstance(df.schema[ds].dataType, T.DateType) else None
    folds = over_rows(
        dates,
        [],
        [ds],
        0,
        lambda w, position, total: {"fold": fold_number(position, total, k)},
        yearly,
    )
    starts = folds.groupBy("fold").agg(F.min(named(ds)).alias("start"))
    ordered = starts.agg(F.array_sort(F.collect_list("start")).alias("starts")).scalar()
    begun = [
        F.coalesce((F.get("__starts", F.lit(i)) <= named(ds)).cast("int"), F.lit(0))
        for i in range(k)
    ]
    return (
        df.withColumn("__starts", ordered)
        .withColumn("fold", reduce(lambda a, b: a + b, begun))
        .drop("__starts")
    )


def series_folds(
    df: DataFrame,
    k: int,
    by: Sequence[str] = ("series_id",),
    order: Sequence[str] = ("ds",),
    chunk: Column | None = None,
) -> DataFrame:
    """Append ``fold`` (1..k): contiguous folds inside each series."""
    return over_rows(
        df,
        by,
        order,
        0,
        lambda w, position, total: {"fold": fold_number(position, total, k)},
        chunk,
    )


def random_split(
    df: DataFrame,
    key: Sequence[str],
    frac: float = 0.2,
    seed: int = 21,
    by: Sequence[str] = (),
    prefix: int | None = None,
) -> DataFrame:
    """Append ``split``: exactly ``ceil(frac * n)`` rows of each group become 'test'.

    Rows are ordered by a hash of key and seed, so the draw does not depend on partitioning.
    The leading ``prefix`` hex digits of the hash are the chunks, even parts of any group: by default
    at least 16 for each partition of ``spark.sql.shuffle.partitions``, and 4,096 at least.
    """
    if prefix is None:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        prefix = max(3, math.ceil(math.log(16 * parts, 16)))
    hashed = df.withColumn(
        "__hash", F.md5(F.concat_ws("|", *[named(c).cast("string") for c in key], F.lit(str(seed))))
    )
    split = over_rows(
        hashed,
        by,
        ["__hash", *key],
        0,
        lambda w, position, total: {
            "split": F.when(position <= F.ceil(total * F.lit(frac)), "test").otherwise("train")
        },
        F.substring("__hash", 1, prefix),
    )
    return split.drop("__hash")
