"""Upper tail probabilities of the chi-square and F distributions.

The inputs are rows of finished reports (one per variable or per model), so a small pandas
UDF is enough; nothing here ever sees respondent rows.
"""
from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F, types as T

_EPS = 1e-15
_TINY = 1e-300


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # power series for the lower tail
        term = total = 1.0 / a
        n = a
        while term > total * _EPS:
            n += 1
            term *= x / n
            total += term
        return 1.0 - scale * total
    # continued fraction, modified Lentz
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 100000):
        an = -i * (i - a)
        b += 2
        d = 1 / _nonzero(an * d + b)
        c = _nonzero(b + an / c)
        h *= c * d
        if abs(c * d - 1) < _EPS:
            break
    return scale * h


def beta_regularised(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_regularised(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / _nonzero(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 100000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / _nonzero(1 + num * d)
            c = _nonzero(1 + num / c)
            h *= c * d
        if abs(c * d - 1) < _EPS:
            break
    return front * h


def _nonzero(v: float) -> float:
    return v if abs(v) > _TINY else _TINY


def _undefined(*values) -> bool:
    return any(v is None or math.isnan(v) for v in values)


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if _undefined(v, k) or k <= 0 else gamma_upper(k / 2, v / 2)
                      for v, k in zip(x, dof)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def f_sf(x: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series([None if _undefined(v, m, n) or m <= 0 or n <= 0
                      else beta_regularised(n / 2, m / 2, n / (n + m * v))
                      for v, m, n in zip(x, df1, df2)], dtype="float64")
