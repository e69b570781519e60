"""Conversions between t, p and z, on NumPy arrays and as Spark columns.

p is one-sided.  ``t_to_z`` carries the sign of t; a p-value below 1e-300 counts as that, so no result is
infinite.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_NORMAL = NormalDist()
LEAST_P = 1e-300


def beta_inc(a, b, x):
    """The regularised incomplete beta function, by its continued fraction."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    a, b, x = a.copy(), b.copy(), x.copy()
    out = np.where(x >= 1, 1.0, 0.0)
    on = (x > 0) & (x < 1)
    if not on.any():
        return out
    a, b, x = a[on], b[on], x[on]
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h *= step
        if np.abs(step - 1).max() < 1e-15:
            break
    y = front * h
    out[on] = np.where(flip, 1 - y, y)
    return out


def t_to_p(t, df):
    """One-sided P(T >= |t|)."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return 0.5 * beta_inc(0.5 * df, 0.5, df / (df + t * t))


def p_to_z(p):
    """The z with upper tail p; 0 outside (0, 1)."""
    p = np.asarray(p, float)
    one = lambda x: -_NORMAL.inv_cdf(x) if 0 < x < 1 else 0.0
    return np.array([one(x) for x in np.maximum(p.ravel(), np.where(p.ravel() > 0, LEAST_P, 0))]).reshape(p.shape)


def z_to_p(z):
    """Upper tail of z."""
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(np.asarray(z, float) / math.sqrt(2))


def t_to_z(t, df):
    t = np.asarray(t, float)
    p = np.maximum(np.minimum(t_to_p(t, df), 0.5), LEAST_P)
    return np.where(np.isfinite(t), np.sign(t) * p_to_z(p), 0.0)


def p_to_t(p, df):
    """The t with upper tail p, by bisection."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    low, high = np.full(p.shape, -1e6), np.full(p.shape, 1e6)
    tail = lambda t: np.where(t >= 0, t_to_p(t, df), 1 - t_to_p(t, df))
    for _ in range(120):
        mid = (low + high) / 2
        more = tail(mid) > p
        low, high = np.where(more, mid, low), np.where(more, high, mid)
    return (low + high) / 2


def t_to_z_approx(t: Column, df: Column) -> Column:
    """sign(t) sqrt(df ln(1 + t^2 / df) (1 - 1 / (2 df))), in plain SQL; 0 where it isn't finite."""
    z = F.signum(t) * F.sqrt(df * F.log(1 + t * t / df) * (1 - F.lit(0.5) / df))
    return F.when(z.isNull() | F.isnan(z) | (F.abs(z) == float("inf")), F.lit(0.0)).otherwise(z)


@F.pandas_udf(DoubleType())
def t_to_z_column(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_to_z(t.fillna(0), df.fillna(1)))


@F.pandas_udf(DoubleType())
def z_to_p_column(z: pd.Series) -> pd.Series:
    return pd.Series(z_to_p(z))


@F.pandas_udf(DoubleType())
def p_to_z_column(p: pd.Series) -> pd.Series:
    return pd.Series(p_to_z(p))
