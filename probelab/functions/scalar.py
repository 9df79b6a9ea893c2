"""Scalar special functions for p-values of one-row statistics.

They are applied to aggregated results (one row per group), never to data
rows; pandas UDFs keep them batched.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def betainc_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) by Lentz's continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - betainc_reg(b, a, 1.0 - x)
    ln_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                + a * math.log(x) + b * math.log1p(-x))
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(0, 400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -((a + m) * (a + b + m) * x) / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + num * d
        d = tiny if abs(d) < tiny else d
        d = 1.0 / d
        c = 1.0 + num / c
        c = tiny if abs(c) < tiny else c
        cd = c * d
        f *= cd
        if abs(1.0 - cd) < 1e-15:
            break
    return math.exp(ln_front) * (f - 1.0) / a


def corr_pvalue(r: float, n: int) -> float:
    """Two-sided p of a correlation r over n pairs (t with n-2 dof)."""
    if r is None or n is None or n < 3 or (isinstance(r, float) and math.isnan(r)):
        return float("nan")
    if abs(r) >= 1.0:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1.0 - r * r)
    return betainc_reg(df / 2.0, 0.5, df / (df + t2))


def normal_two_sided(z: float) -> float:
    """p of ``z``, a distance from the mean in deviations; a continuity
    correction may take it below zero, where p is 1."""
    return min(1.0, math.erfc(z / math.sqrt(2.0)))


@F.pandas_udf(T.DoubleType())
def corr_p_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([corr_pvalue(a, int(b)) if pd.notna(a) and pd.notna(b) else float("nan")
                      for a, b in zip(r, n)])


@F.pandas_udf(T.DoubleType())
def normal_p_udf(z: pd.Series) -> pd.Series:
    return pd.Series([normal_two_sided(v) if pd.notna(v) else float("nan") for v in z])
