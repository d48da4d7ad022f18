from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelcast.functions import expressions
from panelcast.operators import quantiles, screening


def two_sided_t(t: float, df: int) -> float:
    """P(|T| > t) for whole degrees of freedom, by the finite series of Abramowitz and Stegun 26.7.3-4."""
    angle = math.atan(t / math.sqrt(df))
    c, s = math.cos(angle), math.sin(angle)
    total, term = (0.0, c) if df % 2 else (1.0, 1.0)
    if df % 2:
        if df == 1:
            return 1 - 2 * angle / math.pi
        total = c
        for i in range(2, df - 2, 2):
            term *= i / (i + 1) * c * c
            total += term
        return 1 - 2 / math.pi * (angle + s * total)
    for i in range(1, df - 2, 2):
        term *= i / (i + 1) * c * c
        total += term
    return 1 - s * total


# Published upper points of the F distribution: (probability, d1, d2, value).
POINTS = [
    (0.05, 1, 10, 4.964603), (0.05, 5, 20, 2.710890), (0.01, 3, 8, 7.590992), (0.05, 10, 4, 5.964371),
    (0.10, 2, 2, 9.000000), (0.01, 1, 120, 6.850893), (0.05, 24, 24, 1.983760),
]


def test_tail_of_f_against_published_points_and_series(spark):
    rows = [(float(f), d1, d2, p) for p, d1, d2, f in POINTS]
    rows += [(t * t, 1, d, two_sided_t(t, d)) for t in (0.01, 0.5, 1.0, 2.5, 6.0) for d in (1, 2, 3, 7, 30, 395, 4000)]
    frame = spark.createDataFrame(rows, "f double, d1 int, d2 int, p double")
    for r in frame.withColumn("q", expressions.f_tail(F.col("f"), F.col("d1"), F.col("d2"))).collect():
        assert abs(r["q"] - r["p"]) < (2e-6 if (r["p"], r["d1"], r["d2"], r["f"]) in [(p, a, b, f) for p, a, b, f in POINTS] else 1e-11)
    far = spark.createDataFrame([(3.841459, 10**10), (3.841459, 10**7)], "f double, d2 long")
    for r in far.select(expressions.f_tail(F.col("f"), F.lit(1), F.col("d2")).alias("q")).collect():
        assert abs(r["q"] - 0.05) < 1e-6


def test_log_gamma_and_beta(spark):
    z = [1e-3, 0.5, 1.0, 2.0, 7.7, 100.0, 1e5]
    frame = spark.createDataFrame([(a, b) for a in z for b in z], "a double, b double")
    for r in frame.select("a", "b", expressions.log_gamma(F.col("a")).alias("g"), expressions.log_beta(F.col("a"), F.col("b")).alias("w")).collect():
        np.testing.assert_allclose(r["g"], math.lgamma(r["a"]), rtol=1e-12, atol=1e-12)
        want = math.lgamma(r["a"]) + math.lgamma(r["b"]) - math.lgamma(r["a"] + r["b"])
        np.testing.assert_allclose(r["w"], want, rtol=1e-8, atol=1e-8)


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    frame = pd.DataFrame(x, columns=["a", "b", "c d", "noise"])
    frame["c d"] += 0.8 * frame["a"]
    frame["y"] = 2 * frame["a"] - frame["b"] + rng.normal(size=400)
    frame["flat"] = 3.0
    frame.loc[::7, "b"] = np.nan
    frame["g"] = np.where(np.arange(400) < 150, "p", "q")
    return frame


def test_univariate_tests(spark, table):
    df = spark.createDataFrame(table)
    got = {(r["g"], r["feature"]): r for r in screening.f_regression(df, ["a", "b", "noise", "flat"], by=["g"]).collect()}
    for g, own in table.groupby("g"):
        for c in ("a", "b", "noise"):
            pair = own[[c, "y"]].dropna()
            r = np.corrcoef(pair[c], pair["y"])[0, 1]
            f = r * r / (1 - r * r) * (len(pair) - 2)
            row = got[g, c]
            assert row["n"] == len(pair)
            np.testing.assert_allclose([row["r"], row["f"], row["p"]], [r, f, two_sided_t(math.sqrt(f), len(pair) - 2)], rtol=1e-8, atol=1e-12)
        assert got[g, "flat"]["f"] is None and got[g, "flat"]["p"] is None
    exact = df.withColumn("a", F.col("y") * 2)
    row = screening.f_regression(exact, ["a"]).first()
    assert row["f"] == float("inf") and row["p"] == 0.0
    best = screening.select_k_best(df, ["noise", "flat", "b", "a"], 2, ["g"])
    assert best.columns == ["g", "a", "b"]
    assert screening.f_regression(df.limit(2), ["a"]).first()["f"] is None


def test_inflation_factors(spark, table):
    df = spark.createDataFrame(table)
    full = table.dropna()
    got = {r["feature"]: r["vif"] for r in screening.inflation_factors(spark.createDataFrame(full), ["a", "b", "c d", "flat"]).collect()}
    want = np.diag(np.linalg.inv(full[["a", "b", "c d"]].corr().to_numpy()))
    np.testing.assert_allclose([got["a"], got["b"], got["c d"]], want, rtol=1e-9)
    assert got["flat"] is None
    tied = df.withColumn("sum", F.col("a") - 2 * F.col("c d")).withColumn("twin", F.col("noise") * 3 + 1)
    got = {r["feature"]: r["vif"] for r in screening.inflation_factors(tied, ["a", "c d", "sum", "noise", "twin", "y"]).collect()}
    assert [got[c] for c in ("a", "c d", "sum", "noise", "twin")] == [float("inf")] * 5
    assert 1.0 <= got["y"] < 100
    r = table[["a", "b"]].dropna().corr().iloc[0, 1]
    two = {x["feature"]: x["vif"] for x in screening.inflation_factors(df, ["a", "b"]).collect()}
    np.testing.assert_allclose(list(two.values()), [1 / (1 - r * r)] * 2, rtol=1e-9)
    assert [tuple(x) for x in screening.inflation_factors(df, ["a"]).collect()] == [("a", 1.0)]


def brute_information(x, y):
    joint = pd.crosstab(x, y).to_numpy().astype(float)
    p = joint / joint.sum()
    outer = p.sum(axis=1, keepdims=True) * p.sum(axis=0)
    mi = (p[p > 0] * np.log(p[p > 0] / outer[p > 0])).sum()
    kx, ky = (joint.sum(axis=1) > 0).sum(), (joint.sum(axis=0) > 0).sum()
    return mi, mi + (kx + ky - (joint > 0).sum() - 1) / (2 * joint.sum())


def test_mutual_information(spark, table):
    df = spark.createDataFrame(table)
    edges = {"a": [-1.0, 0.0, 1.0], "b": [0.0], "noise": [0.3], "flat": [], "y": [-2.0, 0.0, 2.0]}
    got = {r["feature"]: r for r in screening.mutual_information(df, ["a", "b", "noise", "flat"], edges=edges).collect()}
    for c in ("a", "b", "noise", "flat"):
        own = table[[c, "y"]].dropna()
        x, y = (np.searchsorted(edges[k], own[k], side="left") for k in (c, "y"))
        np.testing.assert_allclose([got[c]["mi"], got[c]["mi_corrected"]], brute_information(x, y), atol=1e-12)
        assert got[c]["n"] == len(own)
    rng = np.random.default_rng(2)
    wide = spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=5000), "z": rng.normal(size=5000)}).assign(y=lambda d: d["z"] ** 2))
    free = {r["feature"]: r["mi_corrected"] for r in screening.mutual_information(wide, ["x", "z"], bins=8).collect()}
    assert abs(free["x"]) < 0.01 and free["z"] > 1.0


def test_quantile_edges_are_exact(spark, table):
    edges = screening.quantile_edges(spark.createDataFrame(table), ["a", "flat", "b"], 4)
    for c in ("a", "b"):
        v = np.sort(table[c].dropna())
        assert edges[c] == [v[math.ceil(p * len(v)) - 1] for p in (0.25, 0.5, 0.75)]
    assert edges["flat"] == [3.0]


@pytest.mark.parametrize("settle", [100_000, 20, 1])
@pytest.mark.parametrize("interpolate", [True, False])
def test_quantiles_of_any_size(spark, settle, interpolate):
    rng = np.random.default_rng(3)
    groups = {
        "hot": np.concatenate([rng.normal(size=900), np.full(600, 0.25), [1e300, -1e300]]),
        "whole": rng.integers(0, 5, 300).astype(float), "one": np.array([-0.0]), "two": np.array([1.0, 2.0]),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("none", None), ("hot", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    found = quantiles.exact_quantiles(df, "v", probs, ["g"], interpolate, settle)
    got = {(r["g"], r["prob"]): r for r in found.collect()}
    assert len(got) == 4 * 6
    for g, values in groups.items():
        v = np.sort(values)
        for p in probs:
            want = np.quantile(v, p) if interpolate else v[max(math.ceil(p * len(v)), 1) - 1]
            np.testing.assert_allclose(got[g, p]["value"], want, rtol=1e-9)
            assert got[g, p]["n"] == len(v)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([0.0, 1.0, 1.5, -3.0, 1e9, 7.0]) | st.floats(-1e6, 1e6), min_size=1, max_size=80))
def test_quantiles_of_a_whole_table(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    found = quantiles.exact_quantiles(df, "v", [0.3, 0.5], settle=3).orderBy("prob").collect()
    np.testing.assert_allclose([r["value"] for r in found], np.quantile(values, [0.3, 0.5]), rtol=1e-9, atol=1e-9)


def test_no_values(spark):
    assert quantiles.exact_quantiles(spark.createDataFrame([], "v double"), "v", [0.5]).count() == 0
