"""Shapley attributions of a fitted model, and the tables read from them."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.expressions import named
from panelcast.operators.quantiles import exact_quantiles



def background_rows(
    df: DataFrame, features: Sequence[str], key: Sequence[str], n: int, seed: int
) -> Column:
    """``n`` reference rows as one array value, drawn by a hash of the key (a top-n, no sort)."""
    text = F.concat_ws("|", *[named(c).cast("string") for c in key], F.lit(str(seed)))
    drawn = df.select(
        F.md5(text).alias("__hash"),
        F.array(*[named(c).cast("double") for c in features]).alias("__b"),
    )
    few = drawn.orderBy("__hash", "__b").limit(n)
    return few.agg(F.array_sort(F.collect_list("__b")).alias("b")).scalar()


def _coalition_values(
    model: Model, rows: DataFrame, background: Column, masks: Sequence[Sequence[int]], m: int
) -> DataFrame:
    """Rows with ``__v``: the mean prediction of each coalition, in the order of ``masks``.

    Every (row, reference row, coalition) is scored by ``model.transform``. The rows are spread by
    key first: all scores of a row arise in one task, so both aggregations and the return to the
    row need no further shuffle, and only the narrow input rows ever move. The partition number is
    explicit because the work per row is many times its size.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    literal = F.array(*[F.array(*[F.lit(bool(b)) for b in mask]) for mask in masks])
    spread = (
        rows.repartition(parts, "__row")
        .select("__row", "__x", F.explode(background).alias("__b"))
        .select("__row", "__x", "__b", F.posexplode(literal).alias("__mask", "__in"))
    )
    mixed = F.array(
        *[
            F.when(F.get("__in", F.lit(i)), F.get("__x", F.lit(i))).otherwise(
                F.get("__b", F.lit(i))
            )
            for i in range(m)
        ]
    )
    scored = model.transform(
        spread.select("__row", "__x", "__mask", array_to_vector(mixed).alias("features"))
    )
    # the inputs are part of the key: an array among the aggregates would sort the scored rows
    means = scored.groupBy("__row", "__x", "__mask").agg(F.avg("prediction").alias("__mean"))
    return means.groupBy("__row", "__x").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("__mask", "__mean"))),
            lambda s: s.getField("__mean"),
        ).alias("__v"),
    )


def _exact_plan(m: int) -> tuple[list[list[int]], list[list[tuple[int, float]]]]:
    """All coalitions, and for each feature the weight of each coalition value in its share."""
    masks = [[(s >> i) & 1 for i in range(m)] for s in range(2**m)]
    weights = []
    for i in range(m):
        terms = []
        for s in range(2**m):
            size = bin(s).count("1")
            if (s >> i) & 1:
                w = math.factorial(size - 1) * math.factorial(m - size) / math.factorial(m)
            else:
                w = -math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
            terms.append((s, w))
        weights.append(terms)
    return masks, weights


def _sampled_plan(
    m: int, n_perm: int, seed: int
) -> tuple[list[list[int]], list[list[tuple[int, float]]]]:
    """Coalitions met by random feature orders, each order also taken backwards."""
    rng = random.Random(seed)
    index: dict[tuple[int, ...], int] = {}
    share: list[dict[int, float]] = [{} for _ in range(m)]
    for _ in range(n_perm):
        drawn = rng.sample(range(m), m)
        for path in (drawn, drawn[::-1]):
            mask = [0] * m
            before = index.setdefault(tuple(mask), len(index))
            for feature in path:
                mask[feature] = 1
                after = index.setdefault(tuple(mask), len(index))
                share[feature][after] = share[feature].get(after, 0.0) + 0.5 / n_perm
                share[feature][before] = share[feature].get(before, 0.0) - 0.5 / n_perm
                before = after
    return [list(mask) for mask in index], [sorted(s.items()) for s in share]


def shapley(
    model: Model,
    rows: DataFrame,
    background: DataFrame,
    features: Sequence[str],
    key: Sequence[str],
    n_background: int = 100,
    n_perm: int = 10,
    seed: int = 21,
    method: str = "exact",
) -> DataFrame:
    """(key, feature, value, phi): the share of each feature in each prediction.

    Absent features take the values of ``n_background`` reference rows. ``method`` 'exact' scores all
    coalitions, two to the number of features; 'sampled' draws ``n_perm`` feature orders. Either way
    the shares of a row sum to its prediction minus the mean prediction of the reference rows.
    """
    if method not in ("exact", "sampled"):
        raise ValueError("method must be 'exact' or 'sampled'")
    m = len(features)
    plan = _exact_plan(m) if method == "exact" else _sampled_plan(m, n_perm, seed)
    masks, weights = plan
    prepared = rows.select(
        F.struct(*[named(c) for c in key]).alias("__row"),
        F.array(*[named(c).cast("double") for c in features]).alias("__x"),
    )
    reference = background_rows(background, features, key, n_background, seed)
    values = _coalition_values(model, prepared, reference, masks, m)

    def share(i: int) -> Column:
        terms = F.array(
            *[F.struct(F.lit(s).alias("s"), F.lit(float(w)).alias("w")) for s, w in weights[i]]
        )
        return F.aggregate(
            terms,
            F.lit(0.0),
            lambda total, t: total + t.getField("w") * F.get("__v", t.getField("s")),
        )

    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.get("__x", F.lit(i)).alias("value"),
                share(i).alias("phi"),
            )
            for i, c in enumerate(features)
        ]
    )
    return values.select(*[F.col("__row").getField(c).alias(c) for c in key], F.inline(entries))


def mean_abs_phi(phi: DataFrame) -> DataFrame:
    """(feature, importance): mean absolute share of each feature."""
    return phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance"))


def shap_importance(phi: DataFrame) -> DataFrame:
    """Features by mean absolute share, largest first. The table has one row per feature."""
    return mean_abs_phi(phi).orderBy(F.desc("importance"), "feature")


def decompose_rows(
    phi: DataFrame, k: int = 15, key: Sequence[str] = ("row_id",), rest: str = "other"
) -> DataFrame:
    """(key, part, value, phi, rank): each row in at most k parts, its k - 1 biggest shares and
    the sum of all others. A row has one entry per feature, so the window is bounded."""
    keys = [named(c) for c in key]
    window = Window.partitionBy(*keys).orderBy(F.desc(F.abs("phi")), "feature")
    count = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ranked = phi.select(
        *keys, "feature", "phi", F.row_number().over(window).alias("__rank"), count.alias("__n")
    )
    alone = (F.col("__rank") < k) | (F.col("__n") <= k)
    return (
        ranked.withColumn("part", F.when(alone, F.col("feature")).otherwise(rest))
        .withColumn("rank", F.when(alone, F.col("__rank")).otherwise(k))
        .groupBy(*keys, "part", "rank")
        .agg(F.sum("phi").alias("phi"))
    )


def phi_distribution(phi: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Spread of the shares per feature: count, mean, extremes and quartiles.

    Quartiles are values of the data, found exactly by selection of ranks. With ``accuracy`` they come from one
    pass with a mergeable sketch whose rank error is 1 / accuracy. A feature's values are never gathered in one task.
    """
    quartiles = {"q25_phi": 0.25, "q50_phi": 0.5, "q75_phi": 0.75}
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.avg("phi").alias("mean_phi"),
        F.min("phi").alias("min_phi"),
        F.max("phi").alias("max_phi"),
    ]
    columns = ["feature", "n", "mean_phi", "min_phi", *quartiles, "max_phi"]
    if accuracy is not None:
        sketch = F.approx_percentile("phi", F.array(*[F.lit(p) for p in quartiles.values()]), accuracy)
        stats = phi.groupBy("feature").agg(*aggs, sketch.alias("__q"))
        return stats.withColumns({c: F.get("__q", F.lit(i)) for i, c in enumerate(quartiles)}).select(*columns)
    found = exact_quantiles(phi, "phi", list(quartiles.values()), ["feature"], interpolate=False)
    wide = found.groupBy("feature").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(c) for c, p in quartiles.items()]
    )
    return phi.groupBy("feature").agg(*aggs).join(wide, "feature").select(*columns)


def phi_dependence(
    phi: DataFrame, features: Sequence[str] | None = None, bins: int = 10
) -> DataFrame:
    """Mean share against the feature's value: (feature, bin, n, mean_value, mean_phi).

    Bins are of equal width between each feature's extremes; a constant feature has bin 0 only.
    ``features`` names the features wanted; their number then bounds the table of extremes, which
    is broadcast. Without it the join strategy is left to the optimizer.
    """
    if features is not None:
        phi = phi.filter(F.col("feature").isin(list(features)))
    extremes = phi.groupBy("feature").agg(
        F.min("value").alias("__lo"), F.max("value").alias("__hi")
    )
    width = (F.col("__hi") - F.col("__lo")) / F.lit(float(bins))
    number = F.when(F.col("__hi") == F.col("__lo"), F.lit(0)).otherwise(
        F.least(
            F.floor((F.col("value") - F.col("__lo")) / F.nullif(width, F.lit(0.0))),
            F.lit(bins - 1),
        )
    )
    return (
        phi.join(extremes if features is None else F.broadcast(extremes), "feature")
        .withColumn("bin", number.cast("int"))
        .groupBy("feature", "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("value").alias("mean_value"),
            F.avg("phi").alias("mean_phi"),
        )
    )
