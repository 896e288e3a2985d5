"""Tail probabilities of one-row test results.

Spark has no error function, so the last step of a hypothesis test runs in a
vectorised UDF over result frames of a few rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_two_sided(z: float) -> float:
    return min(1.0, math.erfc(abs(z) / math.sqrt(2.0)))


def kolmogorov(d: float, n1: float, n2: float) -> float:
    """Asymptotic two-sample Kolmogorov-Smirnov probability."""
    x = d * math.sqrt(n1 * n2 / (n1 + n2))
    if x < 0.2:
        return 1.0
    series = 2.0 * sum((-1) ** (k - 1) * math.exp(-2.0 * k * k * x * x) for k in range(1, 101))
    return min(1.0, max(0.0, series))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / ((1.0 + term * d) or tiny)
        c = (1.0 + term / c) or tiny
        f *= c * d
        if abs(1.0 - c * d) < 1e-14:
            break
    return front / a * (f - 1.0)


def student_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def _rowwise(fn, *columns: pd.Series) -> pd.Series:
    def one(*values):
        return None if any(v is None or v != v for v in values) else fn(*values)

    return pd.Series([one(*v) for v in zip(*columns)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return _rowwise(normal_two_sided, z)


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(student_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def ks_p(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return _rowwise(kolmogorov, d, n1, n2)
