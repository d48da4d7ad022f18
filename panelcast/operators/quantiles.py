"""Exact quantiles of groups of any size, by selection of ranks.

A group's values are never sorted in one place. Every wanted rank has a bracket of values. A round cuts the
rows of a bracket into parts at edges from a mergeable sketch, counts the parts exactly, and goes on with
the part that holds the rank; the sketch only decides how even the parts are. A bracket with few rows is
settled by running counts over its different values. Small groups need no round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.expressions import missing_to_null, named
from panelcast.operators.lineage import attach_facts, cut

SETTLE = 100_000  # rows of a bracket whose values are counted one by one
PARTS = 32  # parts of a bracket per round
ACCURACY = 4_096


def _within(rows: DataFrame, brackets: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, __id, __v): every row once for each bracket that holds it."""
    keys = [named(c) for c in by]
    fields = F.struct("__id", "__low", "__high")
    if by:
        joined = attach_facts(rows, brackets.groupBy(*keys).agg(F.collect_list(fields).alias("__b")), by, "inner")
    else:
        joined = rows.withColumn("__b", brackets.agg(F.collect_list(fields).alias("__b")).scalar())
    holds = F.filter("__b", lambda b: (F.col("__v") >= b["__low"]) & (F.col("__v") <= b["__high"]))
    return joined.select(*keys, "__v", F.explode(holds).alias("__h")).select(*keys, F.col("__h.__id").alias("__id"), "__v")


def _narrowed(rows: DataFrame, brackets: DataFrame, by: Sequence[str]) -> DataFrame:
    """The brackets after a round: the part of each that holds its rank."""
    keys, of = [named(c) for c in by], [*by, "__id"]
    inside = _within(rows, brackets, by)
    at = [F.lit(i / PARTS) for i in range(1, PARTS)]
    edges = inside.groupBy(*keys, "__id").agg(F.approx_percentile("__v", F.array(*at), ACCURACY).alias("__edges"))
    known = attach_facts(inside, edges, of, "inner")
    # an edge's own value is a part by itself, so a crowd of equal values never keeps others in its part
    part = 2 * F.size(F.filter("__edges", lambda e: e < F.col("__v"))) + F.array_contains("__edges", F.col("__v")).cast("int")
    parts = known.groupBy(*keys, "__id", part.alias("__part")).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")
    )
    along = Window.partitionBy(*keys, "__id").orderBy("__part")  # at most 2 PARTS rows
    ranged = parts.withColumn("__before", F.sum("__n").over(along) - F.col("__n"))
    joined = ranged.join(brackets, of).withColumn("__at", F.col("__rank") - F.col("__below"))
    holds = (F.col("__before") <= F.col("__at")) & (F.col("__at") < F.col("__before") + F.col("__n"))
    return joined.filter(holds).select(
        *keys,
        "__id",
        "__rank",
        F.col("__lo").alias("__low"),
        F.col("__hi").alias("__high"),
        (F.col("__below") + F.col("__before")).alias("__below"),
        F.col("__n").alias("__inside"),
    )


def _selected(rows: DataFrame, brackets: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, __id, __value): the value at each bracket's rank, by running counts of its different values."""
    keys, of = [named(c) for c in by], [*by, "__id"]
    values = _within(rows, brackets, by).groupBy(*keys, "__id", "__v").agg(F.count(F.lit(1)).alias("__n"))
    along = Window.partitionBy(*keys, "__id").orderBy("__v")
    running = values.withColumn("__before", F.sum("__n").over(along) - F.col("__n"))
    at = F.col("__rank") - F.col("__below")
    found = running.join(brackets.select(*keys, "__id", "__rank", "__below"), of).filter(
        (F.col("__before") <= at) & (at < F.col("__before") + F.col("__n"))
    )
    return found.select(*keys, "__id", F.col("__v").alias("__value"))


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    interpolate: bool = True,
    settle: int = SETTLE,
) -> DataFrame:
    """(by, prob, n, value): the quantiles of a column per group, exact for groups of any size.

    With ``interpolate`` a quantile lies between its two neighbouring values (position ``p (n - 1)``);
    without, it is the smallest value that at least a share ``p`` of the values does not exceed. Missing
    values (NULL, NaN) do not count; a group without values has no rows.
    """
    keys = [named(c) for c in by]
    source = df.select(*keys, missing_to_null(named(value)).alias("__v")).filter("__v is not null")
    # zero and negative zero are one value
    rows = cut(source.withColumn("__v", F.col("__v") + F.lit(0.0)))
    sizes = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high")
    )
    sizes = cut(sizes.filter("__n > 0"))
    wanted: list[Column] = []
    for i, p in enumerate(probs):
        n = F.col("__n").cast("double")
        if interpolate:
            place = F.lit(float(p)) * (n - 1)
            ranks = (F.floor(place), F.ceil(place))
        else:
            ranks = (F.greatest(F.ceil(F.lit(float(p)) * n), F.lit(1)) - 1,)
        for end, rank in enumerate(ranks):
            wanted.append(F.struct(F.lit(2 * i + end).alias("__id"), rank.cast("bigint").alias("__rank")))
    brackets = sizes.select(*keys, "__low", "__high", F.inline(F.array(*wanted)), F.col("__n").alias("__inside"))
    brackets = brackets.withColumn("__below", F.lit(0).cast("bigint"))
    wide = (F.col("__inside") > settle) & (F.col("__low") < F.col("__high"))
    settled = []
    while True:
        brackets = cut(brackets)
        settled.append(_selected(rows, brackets.filter(~wide), by))
        rest = brackets.filter(wide)
        if rest.isEmpty():
            break
        brackets = _narrowed(rows, rest, by)
    found = settled[0]
    for more in settled[1:]:
        found = found.union(more)
    number = F.floor(F.col("__id") / 2).cast("int")
    pairs = found.groupBy(*keys, number.alias("__i")).agg(
        F.min(F.struct("__id", "__value")).alias("__a"), F.max(F.struct("__id", "__value")).alias("__b")
    )
    known = pairs.join(sizes.select(*keys, "__n"), list(by)) if by else pairs.withColumn(
        "__n", sizes.agg(F.max("__n")).scalar()
    )
    prob = F.get(F.array(*[F.lit(float(p)) for p in probs]), F.col("__i"))
    low, high = F.col("__a.__value"), F.col("__b.__value")
    share = prob * (F.col("__n") - 1) - F.floor(prob * (F.col("__n") - 1))
    result = F.when(low == high, low).otherwise(low + share * (high - low)) if interpolate else low
    return known.select(*keys, prob.alias("prob"), F.col("__n").alias("n"), result.alias("value"))
