"""Quality classifier by hierarchical empirical Bayes over hosts and paths.

A document's own evidence is the calibrated probability of a hashed n-gram model. Hosts and the paths
below them get Beta posteriors from counts: a labelled document counts with its label, any other with
its probability at a discount. A path's prior is its host's posterior, a host's the global share;
how strongly they pull is estimated from the spread between groups, so sparse sites shrink to what
lies above them. The score adds the evidence and the path's posterior in log odds, over the global
share. A document is left out of the counts it is judged by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.expressions import named
from panelcast.llm import quality_rules
from panelcast.operators.lineage import stored

SOFT = 0.25  # weight of a document without a label
KEEP_FROM = 0.3
FLOOR = 1e-3  # probabilities stay this far from 0 and 1 before log odds are added
LEAST, MOST = 1.0, 1e6  # bounds of a prior's weight


def log_odds(p: Column) -> Column:
    bounded = F.least(F.greatest(p, F.lit(FLOOR)), F.lit(1 - FLOOR))
    return F.ln(bounded / (1 - bounded))


def prior_weight(groups: DataFrame, n: str, k: str, centre: Column) -> Column:
    """Aggregate over groups: the weight of their common prior, from spread between and within.

    One-way analysis of variance of shares ``k / n`` around ``centre``; no spread gives the largest
    weight, fewer than two groups too.
    """
    share = F.col(k) / F.col(n)
    between = F.sum(F.col(n) * (share - centre) ** 2) / (F.count("*") - 1)
    within = F.sum(F.col(n) * share * (1 - share)) / F.greatest(F.sum(n) - F.count("*"), F.lit(1.0))
    size = (F.sum(n) - F.sum(F.col(n) ** 2) / F.sum(n)) / (F.count("*") - 1)
    weight = size * within / F.greatest(between - within, F.lit(1e-12))
    found = F.when(F.count("*") > 1, F.least(F.greatest(weight, F.lit(LEAST)), F.lit(MOST)))
    return F.coalesce(found, F.lit(MOST))


def quality_posteriors(
    docs: DataFrame,
    labels: DataFrame,
    host: Column,
    path: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    keep_from: float = KEEP_FROM,
) -> DataFrame:
    """``key``, evidence, host_posterior, path_posterior, score (0 to 1) and kept per row.

    A null host or path is a group of its own. A null text has the evidence of an empty one. Repeated
    label rows of a key count once, with their mean; repeated documents count each. Without labels the
    evidence alone decides against a global share of a half. Texts are whole, however long; other columns are
    ignored. An empty table gives an empty one.
    """
    model = quality_rules.fit_quality(docs, labels, key, text, label)
    grouped = docs.withColumns({"__host": host, "__path": path})
    scored = quality_rules.quality_rules(
        grouped, model, key, text, keep=["__host", "__path"], keep_from=keep_from
    ).select(key, "__host", "__path", F.col("quality").alias("evidence"))
    known = (
        labels.filter(F.col(label).isin(0, 1))
        .groupBy(named(key))
        .agg(F.avg(label).alias("__y"))
        .filter(named(key).isNotNull())
    )
    own = F.coalesce("__y", "evidence")
    rows = stored(
        scored.join(known, key, "left")
        .withColumn("__n", F.when(F.col("__y").isNull(), SOFT).otherwise(1.0))
        .withColumn("__k", F.col("__n") * own)
        .drop("__y")
    )
    sums = [F.sum("__n").alias("n"), F.sum("__k").alias("k")]
    paths = stored(rows.groupBy("__host", "__path").agg(*sums))
    hosts = stored(paths.groupBy("__host").agg(F.sum("n").alias("hn"), F.sum("k").alias("hk")))
    total = hosts.agg(F.sum("hn"), F.sum("hk")).first()
    centre = (total[1] or 0.0) / total[0] if total[0] else 0.5
    host_weight = hosts.agg(prior_weight(hosts, "hn", "hk", F.lit(centre))).first()[0]
    nested = paths.join(hosts, paths["__host"].eqNullSafe(hosts["__host"])).select(
        paths["__host"], "__path", "n", "k", "hn", "hk"
    )
    host_share = (F.col("hk") + host_weight * centre) / (F.col("hn") + host_weight)
    path_weight = nested.agg(prior_weight(nested, "n", "k", host_share)).first()[0]
    facts = nested.select(
        F.col("__host").alias("f_host"), F.col("__path").alias("f_path"), "n", "k", "hn", "hk"
    )
    judged = rows.join(
        facts,
        rows["__host"].eqNullSafe(F.col("f_host")) & rows["__path"].eqNullSafe(F.col("f_path")),
    )
    without = lambda c, mine: F.greatest(F.col(c) - F.col(mine), F.lit(0.0))
    host_posterior = (without("hk", "__k") + host_weight * centre) / (without("hn", "__n") + host_weight)
    path_posterior = (without("k", "__k") + path_weight * F.col("host_posterior")) / (
        without("n", "__n") + path_weight
    )
    odds = log_odds(F.col("evidence")) + log_odds(F.col("path_posterior")) - log_odds(F.lit(centre))
    return (
        judged.withColumn("host_posterior", host_posterior)
        .withColumn("path_posterior", path_posterior)
        .withColumn("score", 1 / (1 + F.exp(-odds)))
        .select(
            key,
            "evidence",
            "host_posterior",
            "path_posterior",
            "score",
            (F.col("score") >= keep_from).alias("kept"),
        )
    )
