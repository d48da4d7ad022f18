"""Seasonal decomposition of every series into trend, seasonal part and rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from panelcast.functions.expressions import missing_to_null, named
from panelcast.operators.lineage import attach_facts
from panelcast.operators.ordered import over_rows

MODES = ("additive", "multiplicative")


def centred_mean(value: Column, w: WindowSpec, m: int) -> Column:
    """Mean over one season around a row, NULL where the season is not full.

    An even season reaches one row further and gives both ends half the weight.
    """
    half = m // 2
    frame = w.rowsBetween(-half, half)
    total = F.sum(value).over(frame)
    if m % 2 == 0:
        total = total - (F.lag(value, half).over(w) + F.lead(value, half).over(w)) / 2.0
    return F.when(F.count(value).over(frame) == 2 * half + 1, total / F.lit(float(m)))


def seasonal_decompose(
    panel: DataFrame,
    m: int = 12,
    mode: str = "additive",
    y: str = "y",
    by: Sequence[str] = ("series_id",),
    order: Sequence[str] = ("ds",),
    chunk: Column | None = None,
) -> DataFrame:
    """Appends trend, seasonal and resid to every row.

    The trend is a centred moving average over ``m`` rows, NULL for half a season at both ends and around
    missing values. The seasonal part is the mean per phase of what the trend leaves, ``y - trend``, or ``y / trend`` in mode
    'multiplicative', moved so that the phases of a series have mean 0 (or 1). The phase is the row's position modulo ``m``.
    A series shorter than a season has no trend and no seasonal part. Phase means are
    one row per series and phase; the data rows cross one shuffle, cut into chunks where a series may be long.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if m < 2:
        raise ValueError("a season has two rows at least")
    half = m // 2
    value = missing_to_null(named(y))
    times = mode == "multiplicative"

    def build(w: WindowSpec, position: Column, total: Column) -> dict[str, Column]:
        return {"trend": centred_mean(value, w, m), "__phase": ((position - 1) % m).cast("int")}

    rows = over_rows(panel, by, order, half, build, chunk, ahead=half)
    left = value / F.nullif("trend", F.lit(0.0)) if times else value - F.col("trend")
    keys = [named(c) for c in by]
    phases = rows.groupBy(*keys, "__phase").agg(F.avg(left).alias("__mean"))
    # the phases of a series are few: their mean is taken over an array
    gathered = phases.groupBy(*keys).agg(F.collect_list(F.struct("__phase", "__mean")).alias("__all"))
    means = F.filter(F.transform("__all", lambda p: p["__mean"]), lambda x: x.isNotNull())
    centre = F.aggregate(means, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(means), F.lit(0))
    moved = (F.col("p.__mean") / F.col("__centre")) if times else F.col("p.__mean") - F.col("__centre")
    facts = (
        gathered.withColumn("__centre", centre)
        .select(*keys, "__centre", F.explode("__all").alias("p"))
        .select(*keys, F.col("p.__phase").alias("__phase"), moved.alias("seasonal"))
    )
    joined = attach_facts(rows, facts, [*by, "__phase"])
    trend, season = F.col("trend"), F.col("seasonal")
    resid = value / F.nullif(trend * season, F.lit(0.0)) if times else value - trend - season
    return joined.withColumn("resid", resid).select(
        *[named(c) for c in panel.columns], "trend", "seasonal", "resid"
    )
