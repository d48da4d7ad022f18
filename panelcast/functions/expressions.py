"""Scalar column expressions that stay inside generated JVM code."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def named(name: str) -> Column:
    """Column by its literal name; safe for names holding spaces or dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def missing_to_null(c: Column) -> Column:
    """One missing marker: NaN becomes NULL, so aggregates skip it."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation over the rows that have both; NULL where one is constant, on which the
    built-in function raises."""
    spread = F.sqrt(F.regr_sxx(y, x)) * F.sqrt(F.regr_syy(y, x))
    return F.regr_sxy(y, x) / F.nullif(spread, F.lit(0.0))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function (Abramowitz & Stegun 7.1.26, error below 1.5e-7)."""
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    # Fixed values of the published approximation, highest power first.
    poly = F.lit(1.061405429)
    for a in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = poly * t + F.lit(a)
    erf = F.lit(1.0) - poly * t * F.exp(-x * x)
    return F.when(z >= 0, (F.lit(1.0) + erf) / 2.0).otherwise((F.lit(1.0) - erf) / 2.0)


def days_since_epoch(df: DataFrame, ds: str) -> Column:
    """Time in days as a double, for a DATE or a timestamp column."""
    if isinstance(df.schema[ds].dataType, T.DateType):
        return F.unix_date(named(ds)).cast("double")
    return F.unix_micros(named(ds).cast("timestamp")) / F.lit(86400e6)


def fourier_terms(days: Column, period: float, order: int) -> list[tuple[str, Column]]:
    terms = []
    for k in range(1, order + 1):
        angle = F.lit(2.0 * math.pi * k) * days / F.lit(float(period))
        terms.append((f"sin_{k}", F.sin(angle)))
        terms.append((f"cos_{k}", F.cos(angle)))
    return terms


def fourier_features(
    df: DataFrame, period: float = 365.25, order: int = 5, ds: str = "ds"
) -> DataFrame:
    """Append ``sin_k`` and ``cos_k`` for k = 1..order; time is counted in days."""
    days = days_since_epoch(df, ds)
    return df.select("*", *[c.alias(n) for n, c in fourier_terms(days, period, order)])


def hinge(t: Column, knot: Column) -> Column:
    return F.greatest(F.lit(0.0), t - knot)


def changepoint_features(
    df: DataFrame, n: int, t: str = "t", share: float = 0.8
) -> DataFrame:
    """Append ``cp_j = max(0, t - s_j)``, the n knots evenly spaced over the first ``share`` of
    scaled time ``t`` in [0, 1]."""
    knots = [share * j / n for j in range(1, n + 1)]
    return df.select(
        "*", *[hinge(named(t), F.lit(s)).alias(f"cp_{j}") for j, s in enumerate(knots, 1)]
    )


def dot(a: Column, b: Column) -> Column:
    """Inner product of two double arrays of equal length."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x
    )


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function of a positive number: Stirling's series, eight steps further on."""
    w = z + 8.0
    product = z
    for i in range(1, 8):
        product = product * (z + float(i))
    # Fixed values of the published series, in rising powers of 1 / w.
    series = 1 / (12 * w) - 1 / (360 * w**3) + 1 / (1260 * w**5) - 1 / (1680 * w**7) + 1 / (1188 * w**9)
    return (w - 0.5) * F.ln(w) - w + F.lit(0.5 * math.log(2 * math.pi)) + series - F.ln(product)


def log_beta(a: Column, b: Column) -> Column:
    """Logarithm of the beta function; a quotient's series where one argument is much the larger, as
    there the logarithms of two gamma functions cancel."""
    big, small = F.greatest(a, b), F.least(a, b)
    u = small * (small - 1)
    rise = small * F.ln(big) + u / (2 * big) - u * (2 * small - 1) / (12 * big**2) + u * u / (12 * big**3)
    plain = log_gamma(a + b) - log_gamma(big)
    return log_gamma(small) - F.when(big > 1e4 * (1 + small * small), rise).otherwise(plain)


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function of x in [0, 1], by its continued fraction.

    Steps follow the square root of the larger argument, at most 20,000.
    """
    tiny = F.lit(1e-300)

    def kept(v: Column) -> Column:
        return F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def fraction(x: Column, a: Column, b: Column) -> Column:
        steps = F.least(F.lit(20_000), (80 + 4 * F.sqrt(F.greatest(a, b))).cast("int"))
        first = 1.0 / kept(1 - (a + b) * x / (a + 1))
        start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

        def half(state: Column, part: Column) -> Column:
            d, c = 1.0 / kept(1 + part * state["d"]), kept(1 + part / state["c"])
            return F.struct(c.alias("c"), d.alias("d"), (state["h"] * c * d).alias("h"))

        def step(state: Column, i: Column) -> Column:
            m = i.cast("double")
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return half(half(state, even), odd)

        return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["h"])

    front = F.exp(a * F.ln(x) + b * F.ln(1 - x) - log_beta(a, b))
    inside = F.when(x < (a + 1) / (a + b + 2), front * fraction(x, a, b) / a).otherwise(
        1 - front * fraction(1 - x, b, a) / b
    )
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(inside)


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    """Probability of an F statistic of (d1, d2) degrees of freedom above ``f``."""
    d1, d2 = d1.cast("double"), d2.cast("double")
    return incomplete_beta(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)
