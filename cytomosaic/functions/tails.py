"""Tail probabilities that Spark SQL lacks.

The normal tail is a native expression. Student-t and chi-squared tails run as Arrow UDFs; they are
only ever applied to result tables bounded by genes x groups.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def erfc_abs(x: Column) -> Column:
    """erfc(|x|): a positive-term power series below 3, a continued fraction above."""
    a = F.abs(x)
    down = lambda n: F.array(*[F.lit(float(i)) for i in range(n, 0, -1)])
    series = F.aggregate(down(60), F.lit(1.0), lambda acc, n: 1.0 + acc * 2.0 * a * a / (2.0 * n + 1.0))
    fraction = F.aggregate(down(60), a, lambda acc, n: a + n / 2.0 / acc)
    root_pi = math.sqrt(math.pi)
    small = F.greatest(F.lit(0.0), 1.0 - 2.0 / root_pi * a * F.exp(-a * a) * series)
    return F.when(a < 3.0, small).otherwise(F.exp(-a * a) / root_pi / fraction)


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) for a standard normal Z; NULL in, NULL out."""
    return F.when(z.isNotNull() & ~F.isnan(z), erfc_abs(z / math.sqrt(2.0)))


def _betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (modified Lentz), vectorised."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    flip = x > (a + 1.0) / (a + b + 2.0)
    p, q, t = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1.0 - x, x)
    lgam = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lgam(p + q) - lgam(p) - lgam(q) + p * np.log(t) + q * np.log1p(-t)) / p
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(t)
    d = 1.0 / guard(1.0 - (p + q) * t / (p + 1.0))
    h = d.copy()
    for m in range(1, 300):
        for num in (
            m * (q - m) * t / ((p + 2 * m - 1.0) * (p + 2 * m)),
            -(p + m) * (p + q + m) * t / ((p + 2 * m) * (p + 2 * m + 1.0)),
        ):
            d = 1.0 / guard(1.0 + num * d)
            c = guard(1.0 + num / c)
            h = h * d * c
    value = np.where(t <= 0.0, 0.0, front * h)
    return np.where(flip, 1.0 - value, value)


def t_sf_two_sided_np(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    ok = np.isfinite(t) & np.isfinite(df) & (df > 0)
    safe_t, safe_df = np.where(ok, t, 0.0), np.where(ok, df, 1.0)
    return np.where(ok, _betainc(safe_df / 2.0, np.full_like(safe_df, 0.5), safe_df / (safe_df + safe_t**2)), np.nan)


def t_quantile_np(prob: float, df: np.ndarray) -> np.ndarray:
    """Upper quantile (prob > 0.5) by bisection on the two-sided tail."""
    df = np.asarray(df, dtype=float)
    target = 2.0 * (1.0 - prob)
    lo, hi = np.zeros_like(df), np.full_like(df, 1e8)
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        heavy = t_sf_two_sided_np(mid, df) > target
        lo, hi = np.where(heavy, mid, lo), np.where(heavy, hi, mid)
    return np.where(np.isfinite(df) & (df > 0), 0.5 * (lo + hi), np.nan)


def _gammaincc(s: float, x: float) -> float:
    if x <= 0.0:
        return 1.0
    front = math.exp(-x + s * math.log(x) - math.lgamma(s))
    if x < s + 1.0:
        term = total = 1.0 / s
        k = s
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - front * total
    b = x + 1.0 - s
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - s)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
    return front * h


def _none(values: np.ndarray) -> pd.Series:
    return pd.Series(values).astype(object).where(np.isfinite(values), None)


def _t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return _none(t_sf_two_sided_np(t.to_numpy(float), df.to_numpy(float)))


def _t_upper(df: pd.Series) -> pd.Series:
    return _none(t_quantile_np(0.975, df.to_numpy(float)))


def _chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    pairs = zip(x, df)
    return pd.Series([
        None if pd.isna(v) or pd.isna(k) else _gammaincc(float(k) / 2.0, float(v) / 2.0) for v, k in pairs], dtype=object)


def t_two_sided(t: Column, df: Column) -> Column:
    return F.pandas_udf(_t_tail, "double")(t, df)


def t_quantile_975(df: Column) -> Column:
    return F.pandas_udf(_t_upper, "double")(df)


def chi2_sf(x: Column, df: Column) -> Column:
    return F.pandas_udf(_chi2_tail, "double")(x, df)
