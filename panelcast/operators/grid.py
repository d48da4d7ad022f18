"""Parameter grids as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.expressions import named


def grid_points(grid: Mapping[str, Sequence[object]]) -> list[dict[str, object]]:
    """All combinations; names in sorted order, the last name varies fastest."""
    names = sorted(grid)
    return [dict(zip(names, values)) for values in product(*[grid[n] for n in names])]


def _text(value: Column) -> Column:
    return value.cast("string")


def param_grid(
    series: DataFrame, grid: Mapping[str, Sequence[object]], keys: Sequence[str] = ("series_id",)
) -> DataFrame:
    """One row per series and parameter combination: (keys, trial_id, one column per name).

    Each list is exploded next to the series, so the trials of a series are made where the
    series is and no join takes place. ``trial_id`` counts from 1 in the order of the grid.
    """
    names = sorted(grid)
    trials = series.select(*[named(c) for c in keys], F.lit(0).alias("trial_id"))
    for name in names:
        values = F.array(*[F.lit(v) for v in grid[name]])
        trials = trials.select("*", F.posexplode(values).alias("__pos", name)).withColumn(
            "trial_id", F.col("trial_id") * F.lit(len(grid[name])) + F.col("__pos")
        ).drop("__pos")
    return trials.withColumn("trial_id", F.col("trial_id") + 1)


def params_map(names: Sequence[str]) -> Column:
    """The parameters of a trial row as MAP<STRING, STRING>."""
    entries: list[Column] = []
    for n in names:
        entries += [F.lit(n), _text(named(n))]
    return F.create_map(*entries)


def trial_log(
    scores: DataFrame, names: Sequence[str], metric: str, keys: Sequence[str] = ("series_id",)
) -> DataFrame:
    """(keys, trial_id, params, metric): the log of a search in its common form."""
    return scores.select(
        *[named(c) for c in keys],
        "trial_id",
        params_map(names).alias("params"),
        named(metric).alias("metric"),
    )
