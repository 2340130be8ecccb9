"""Normal quantile and chi-square tail without scipy."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Smallest p-value reported, so a printed p is never an exact zero.
P_FLOOR = 2.2250738585072014e-308


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def chi2_tail(x: float, df: float) -> float:
    """Upper tail of the chi-square distribution: regularised Q(df/2, x/2)."""
    if x is None or df is None or not math.isfinite(x) or df <= 0:
        return math.nan
    if x <= 0:
        return 1.0
    a, z = df / 2.0, x / 2.0
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a)) if z < 745 + a * math.log(z) - math.lgamma(a) else 0.0
    if z < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= z / n
            total += term
        return max(0.0, 1.0 - total * scale)
    # Lentz's method for the continued fraction of the upper tail.
    tiny = 1e-300
    b = z + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2.0
        d = step * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + step / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return h * scale


@F.pandas_udf(T.DoubleType())
def chi2_tail_udf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(a, b) for a, b in zip(x, df)], dtype="float64").where(x.notna() & df.notna())
