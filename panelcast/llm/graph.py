"""Connected components of links between keys, without a group or the links in one place."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.lineage import cut


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node each of ``n`` nodes reaches by the links (a, b); for one bounded block."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
        if (root == before).all():
            break
    return root


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the links (a, b): the smallest node it reaches.

    Alternates two steps until nothing changes: every node hands its smallest neighbour to its larger
    neighbours, then to itself and its smaller ones. Each step is an aggregation and a join by node, so a
    hub's links are split like any skewed join. Links with a null end, loops and repeats are ignored;
    no links give no rows. Raises if ``rounds`` do not suffice (they grow with the logarithm).
    """
    pairs = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = cut(pairs.filter("u is not null and v is not null and u <> v").distinct())
    state = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u <> v").select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        ).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            joined.select("u", F.col("m").alias("v"))
        )
        edges = cut(small.filter("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("connected components did not settle")
    own = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return own.union(centres)
