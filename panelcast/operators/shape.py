"""Slicing, column selection, typing and joins of panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.expressions import missing_to_null, named
from panelcast.functions.names import feature_cols, not_matching, variant_last

KEY = ("series_id", "ds")


def select_names(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[named(c) for c in names])


def slice_panel(df: DataFrame, **equals: object) -> DataFrame:
    """Keep the rows that equal every given value; NULL never matches."""
    for name, value in equals.items():
        df = df.filter(named(name) == F.lit(value))
    return df


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Remove the columns whose name contains ``pattern``."""
    return select_names(df, not_matching(df.columns, pattern))


def keep_variant(df: DataFrame, keep: str = "Ncov", family: str = "cov") -> DataFrame:
    """Of the ``family`` columns keep only the ``keep`` variant, moved to the end."""
    return select_names(df, variant_last(df.columns, keep, family))


def cast_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cast columns to double in one projection; malformed text raises under ANSI mode."""
    chosen = set(cols)
    return df.select(
        *[missing_to_null(named(c)).alias(c) if c in chosen else named(c) for c in df.columns]
    )


def parse_ds(df: DataFrame, col: str, fmt: str = "yyyy-MM-dd") -> DataFrame:
    return df.withColumn(col, F.to_date(named(col), fmt))


def split_target(
    df: DataFrame, keys: Sequence[str], targets: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(features, targets), both carrying the keys."""
    features = feature_cols(df.columns, list(targets) + list(keys))
    return select_names(df, [*keys, *features]), select_names(df, [*keys, *targets])


def ranked_names(ranking: DataFrame, k: int, name: str = "attribute", score: str = "importance"):
    """The k best names of a ranking: k short strings are all that reaches the driver."""
    best = ranking.orderBy(F.desc(score), name).limit(k).select(name)
    return [row[0] for row in best.collect()]


def select_ranked(df: DataFrame, ranking: DataFrame, k: int, keys: Sequence[str]) -> DataFrame:
    return select_names(df, [*keys, *ranked_names(ranking, k)])


def to_model_frame(df: DataFrame, ds: str = "date", y: str = "total_market") -> DataFrame:
    return df.withColumnsRenamed({ds: "ds", y: "y"})


def between_dates(df: DataFrame, start: str, end: str, ds: str = "ds") -> DataFrame:
    """Closed date range. The literals are dates, so the filter reaches the scan."""
    return df.filter(named(ds).between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def strip_tz(df: DataFrame, col: str = "ds") -> DataFrame:
    """Timestamps without a zone; the wall-clock reading in the session zone is kept."""
    if isinstance(df.schema[col].dataType, T.TimestampType):
        return df.withColumn(col, named(col).cast("timestamp_ntz"))
    return df


def attach_features(
    dates: DataFrame, features: DataFrame, keys: Sequence[str] = KEY
) -> DataFrame:
    """Left join by key; rows without features stay, with NULLs."""
    return dates.join(features, list(keys), "left")


def attach_column(
    df: DataFrame, other: DataFrame, col: str, keys: Sequence[str] = KEY
) -> DataFrame:
    """Zip a column of another frame by key instead of by row position."""
    return df.join(select_names(other, [*keys, col]), list(keys), "inner")


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def sort_by_date(df: DataFrame, ds: str = "ds", ties: Sequence[str] = ("series_id",)) -> DataFrame:
    """Global order for final output. Tie columns let a range sort split a crowded date."""
    return df.orderBy(named(ds), *[named(c) for c in ties])


def top_k(
    df: DataFrame, col: str, k: int, ties: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """k largest rows overall or per group.

    Overall: each task keeps k rows before the merge. Per group: the ``rank <= k`` filter becomes a
    group limit that runs before the shuffle, so a crowded group sends k rows per task.
    """
    order = [F.desc_nulls_last(named(col)), *[named(c) for c in ties]]
    if not by:
        return df.orderBy(*order).limit(k)
    from pyspark.sql import Window

    window = Window.partitionBy(*[named(c) for c in by]).orderBy(*order)
    return (
        df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k).drop("rank")
    )


def densify(
    df: DataFrame, step: str = "interval 1 month", key: str = "series_id", ds: str = "ds"
) -> DataFrame:
    """Give each series one row per step between its first and last date; new rows hold NULLs."""
    span = df.groupBy(named(key)).agg(F.min(ds).alias("__lo"), F.max(ds).alias("__hi"))
    calendar = span.select(
        named(key), F.explode(F.sequence("__lo", "__hi", F.expr(step))).alias(ds)
    )
    return calendar.join(df, [key, ds], "left").select(*[named(c) for c in df.columns])
