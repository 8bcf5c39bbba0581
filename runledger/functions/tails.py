"""Tails of Student's t and of the F distribution, evaluated on aggregated rows.

Both come from the regularised incomplete beta function, computed with its continued fraction on
whole Arrow batches. The inputs are one row per group or test, never raw measurements.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    result = d.copy()
    for m in range(1, 100_000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + numerator / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            result = result * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return result


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b) for positive a, b and x in [0, 1]."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    result = np.where(x >= 1.0, 1.0, 0.0)
    inside = (x > 0.0) & (x < 1.0)
    if inside.any():
        p, q, y = a[inside], b[inside], x[inside]
        swap = y > (p + 1.0) / (p + q + 2.0)
        p, q, y = np.where(swap, q, p), np.where(swap, p, q), np.where(swap, 1.0 - y, y)
        front = _log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(y) + q * np.log1p(-y)
        value = np.exp(front) * beta_fraction(p, q, y) / p
        result[inside] = np.where(swap, 1.0 - value, value)
    return result


def f_survival(f, dfn, dfd) -> np.ndarray:
    """P(F > f); NaN where the statistic or a degree of freedom is not usable."""
    f, dfn, dfd = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(f, dfn, dfd))
    result = np.full(f.shape, np.nan)
    infinite = np.isinf(f) & (dfn > 0) & (dfd > 0)
    result[infinite] = 0.0
    usable = np.isfinite(f) & (f >= 0) & (dfn > 0) & (dfd > 0)
    d1, d2, s = dfn[usable], dfd[usable], f[usable]
    result[usable] = beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * s))
    return result


def t_two_sided(t, df) -> np.ndarray:
    """P(|T| > |t|)."""
    t, df = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(t, df))
    return f_survival(t * t, np.ones_like(df), df)


def t_quantile(df, confidence: float = 0.95) -> np.ndarray:
    """Two-sided critical value: P(|T| <= t) = confidence; NaN where df < 1."""
    df = np.asarray(df, dtype=float)
    result = np.full(df.shape, np.nan)
    usable = df >= 1
    if not usable.any():
        return result
    small = usable & (df <= 1000)
    if small.any():
        # Many groups share a size, so each degree of freedom is solved once.
        d, place = np.unique(df[small], return_inverse=True)
        result[small] = _solve_t(d, confidence)[place]
    large = usable & ~small
    if large.any():
        # Expansion of the t quantile about the normal one in powers of 1/df; below 1e-15 here.
        d, z = df[large], normal_quantile((1.0 + confidence) / 2.0)
        g1 = (z**3 + z) / 4.0
        g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96.0
        g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384.0
        g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160.0
        result[large] = z + g1 / d + g2 / d**2 + g3 / d**3 + g4 / d**4
    return result


def _solve_t(d: np.ndarray, confidence: float) -> np.ndarray:
    """Newton's method on the two-sided tail, kept within a bracket that halves where a step leaves it."""
    low, high = np.zeros_like(d), np.full_like(d, math.tan(math.pi * confidence / 2.0) * 1.001)
    t = np.full_like(d, normal_quantile((1.0 + confidence) / 2.0))
    scale = 2.0 * np.exp(_log_gamma((d + 1.0) / 2.0) - _log_gamma(d / 2.0)) / np.sqrt(d * math.pi)
    for _ in range(200):
        error = t_two_sided(t, d) - (1.0 - confidence)
        low, high = np.where(error > 0, t, low), np.where(error > 0, high, t)
        step = error / (scale * (1.0 + t * t / d) ** (-(d + 1.0) / 2.0))
        guess = t + step
        guess = np.where((guess > low) & (guess < high), guess, (low + high) / 2.0)
        if np.all(np.abs(guess - t) <= 1e-15 * t):
            return guess
        t = guess
    return t


def normal_quantile(p: float) -> float:
    """Normal quantile by Newton's method on ``erfc``."""
    z = 0.0
    for _ in range(100):
        density = math.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi)
        step = (0.5 * math.erfc(-z / math.sqrt(2.0)) - p) / density
        z -= max(-1.0, min(1.0, step))
        if abs(step) < 1e-16:
            break
    return z


def gamma_upper(a, x) -> np.ndarray:
    """Regularised upper incomplete gamma function Q(a, x): by its series below a + 1, else by its continued fraction."""
    a, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, x))
    result = np.where(x > 0, 0.0, 1.0)
    inside = (x > 0) & np.isfinite(x)
    series = inside & (x < a + 1)
    if series.any():
        p, y = a[series], x[series]
        term, at = 1.0 / p, p.copy()
        total = term.copy()
        while np.any(term > 1e-17 * total):
            at += 1.0
            term = term * y / at
            total += term
        result[series] = 1.0 - total * np.exp(p * np.log(y) - y - _log_gamma(p))
    rest = inside & ~series
    if rest.any():
        p, y = a[rest], x[rest]
        b, c = y + 1.0 - p, np.full_like(y, 1e300)
        d = 1.0 / b
        h, step, i = d.copy(), np.zeros_like(y), 0
        while np.any(np.abs(step - 1.0) > 1e-15):
            i += 1
            b = b + 2.0
            d = 1.0 / (-i * (i - p) * d + b)
            c = b - i * (i - p) / c
            step = c * d
            h = h * step
        result[rest] = h * np.exp(p * np.log(y) - y - _log_gamma(p))
    return result


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    """p-value of a chi-square statistic; NaN where the statistic or the degrees of freedom are not usable."""
    statistic, dof = x.to_numpy(float, na_value=np.nan), df.to_numpy(float, na_value=np.nan)
    usable = (statistic >= 0) & (dof > 0)
    result = np.full(len(statistic), np.nan)
    result[usable] = gamma_upper(dof[usable] / 2.0, statistic[usable] / 2.0)
    return pd.Series(result)


@F.pandas_udf(DoubleType())
def f_tail(f: pd.Series, dfn: pd.Series, dfd: pd.Series) -> pd.Series:
    """p-value of an F statistic."""
    return pd.Series(f_survival(f, dfn, dfd))


@F.pandas_udf(DoubleType())
def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of a t statistic."""
    return pd.Series(t_two_sided(t, df))


def t_critical(df, confidence: float = 0.95):
    """Critical value of t as a column; null where there is no degree of freedom."""

    @F.pandas_udf(DoubleType())
    def critical(d: pd.Series) -> pd.Series:
        return pd.Series(t_quantile(d, confidence))

    value = critical(df.cast("double"))
    return F.when(~F.isnan(value), value)
