"""Distribution tails for small result tables (one row per test)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

def _lgamma(x):
    return np.vectorize(math.lgamma, otypes=[float])(x)


def beta_fraction(a, b, x):
    """Regularised incomplete beta I_x(a, b) by its continued fraction."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    z = np.clip(z, 0.0, 1.0)
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for m in range(1, 400):
        for numerator in (
            m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1 + numerator * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + numerator / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            f = f * step
        if np.nanmax(np.abs(step - 1), initial=0) < 1e-15:
            break
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    value = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * f))
    return np.where(swap, 1 - value, value)


def gamma_upper(s, x):
    """Regularised upper incomplete gamma Q(s, x), element by element."""
    def one(s, x):
        if not (np.isfinite(s) and np.isfinite(x)):
            return 0.0 if x == math.inf else math.nan
        if x <= 0:
            return 1.0
        scale = math.exp(-x + s * math.log(x) - math.lgamma(s))
        if x < s + 1:
            term = total = 1 / s
            n = s
            while abs(term) > abs(total) * 1e-16:
                n += 1
                term *= x / n
                total += term
            return 1 - total * scale
        b, c = x + 1 - s, 1e300
        d = 1 / b
        h = d
        for i in range(1, 10_000):
            an = -i * (i - s)
            b += 2
            d = 1 / (an * d + b or 1e-300)
            c = b + an / c or 1e-300
            h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return scale * h
    return np.array([one(float(a), float(b)) for a, b in zip(*np.broadcast_arrays(s, x))])


def t_two_sided(t, df):
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return beta_fraction(df / 2, 0.5, df / (df + t * t))


def f_upper(f, d1, d2):
    f, d1, d2 = (np.asarray(v, dtype=float) for v in (f, d1, d2))
    return beta_fraction(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def normal_two_sided(z):
    return np.array([math.erfc(abs(v) / math.sqrt(2)) for v in np.asarray(z, dtype=float)])


def t_quantile(p, df):
    """Upper t quantile by bisection on the tail."""
    p, df = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(p, df))
    low, high = np.zeros_like(df), np.full_like(df, 1e4)
    for _ in range(100):
        middle = (low + high) / 2
        above = t_two_sided(middle, df) / 2 > 1 - p
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return (low + high) / 2


def fisher_two_sided(a, b, c, d):
    """Total probability of the 2x2 tables that are no likelier than the observed one."""
    def one(a, b, c, d):
        row, col, n = a + b, a + c, a + b + c + d
        # Forty deviations around the mode hold all of the probability that a double can show.
        mode = (row + 1) * (col + 1) // (n + 2)
        reach = 50 + int(40 * math.sqrt(row * col / n * (n - row) / n * (n - col) / max(1, n - 1)))
        low, high = max(0, col - (n - row)), min(row, col)
        if not mode - reach <= a <= mode + reach:
            return 0.0
        k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1)
        logs = (_lgamma(row + 1.0) + _lgamma(n - row + 1.0) + _lgamma(col + 1.0) + _lgamma(n - col + 1.0)
                - _lgamma(n + 1.0) - _lgamma(k + 1.0) - _lgamma(row - k + 1.0)
                - _lgamma(col - k + 1.0) - _lgamma(n - row - col + k + 1.0))
        seen = logs[k == a][0]
        return min(1.0, float(np.exp(logs[logs <= seen + 1e-7]).sum()))
    return np.array([one(*map(int, row)) for row in zip(a, b, c, d)])


def chi_square_upper(x, df):
    """Upper tail of chi-square."""
    return gamma_upper(np.asarray(df, dtype=float) / 2, np.asarray(x, dtype=float) / 2)


def _spark(kernel):
    def run(*columns: pd.Series) -> pd.Series:
        arrays = [c.astype(float).to_numpy() for c in columns]
        known = ~np.any([np.isnan(a) for a in arrays], axis=0)
        out = np.full(len(known), np.nan)
        if known.any():
            out[known] = kernel(*[a[known] for a in arrays])
        return pd.Series(out).where(~np.isnan(out), None).astype("float64")
    return run


def _udf(kernel, arity: int):
    run = _spark(kernel)
    if arity == 1:
        def call(a: pd.Series) -> pd.Series:
            return run(a)
    elif arity == 2:
        def call(a: pd.Series, b: pd.Series) -> pd.Series:
            return run(a, b)
    elif arity == 3:
        def call(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return run(a, b, c)
    else:
        def call(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
            return run(a, b, c, d)
    udf = F.pandas_udf(call, "double")
    return lambda *columns: F.nullif(udf(*columns), F.lit(float("nan")))


def t_p(t, df):
    """Two-sided p-value of a t statistic."""
    return _udf(t_two_sided, 2)(t, df)


def f_p(f, d1, d2):
    """Upper p-value of an F statistic."""
    return _udf(f_upper, 3)(f, d1, d2)


def chi_square_p(x, df):
    """Upper p-value of a chi-square statistic."""
    return _udf(chi_square_upper, 2)(x, df)


def normal_p(z):
    """Two-sided p-value of a standard normal statistic."""
    return _udf(normal_two_sided, 1)(z)


def t_975(df):
    """The 0.975 quantile of t."""
    return _udf(lambda d: t_quantile(0.975, d), 1)(df)


def fisher_p(a, b, c, d):
    """Two-sided exact p-value of a 2x2 table."""
    return _udf(fisher_two_sided, 4)(a, b, c, d)
