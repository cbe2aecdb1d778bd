"""Tail probabilities of the binomial, Student's t, chi-square and normal distributions, over whole arrays.

All come from two functions: the regularised incomplete beta and gamma.  Each is a leading factor in
Loader's saddle-point form, which keeps its digits for large arguments, times a continued fraction or a series that runs for all
rows of a batch at once and stops when the last row has settled.  Logarithms are carried, so that tails of 1e-5000 stay apart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TINY, _EPS = 1e-300, 1e-15
_HALF_LOG_2PI = 0.5 * np.log(2 * np.pi)


def stirling_error(n: np.ndarray) -> np.ndarray:
    """log n! - log(sqrt(2 pi n) (n/e)^n) for n > 0."""
    big = n + np.where(n < 16, 16.0, 0.0)
    out = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / big**2) / big**2) / big**2) / big**2) / big
    small = n < 16
    if small.any():
        m, b = n[small], big[small]
        factorial = (b + 0.5) * np.log(b) - b + out[small]
        for j in range(1, 17):
            factorial -= np.log(m + j)
        out[small] = factorial - (m + 0.5) * np.log(m) + m
    return out


def deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x log(x / mean) + mean - x, without loss where x is near the mean."""
    v = (x - mean) / (x + mean)
    near = np.abs(v) < 0.1
    series, term = (x - mean) * v, 2 * x * np.where(near, v, 0.0)
    for j in range(1, 16):
        term = term * v * v
        series = series + term / (2 * j + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(near, series, x * np.log(x / mean) + mean - x)


def _fraction(first: np.ndarray, step) -> np.ndarray:
    """first + a1/(b1 + a2/(b2 + ...)) by the modified Lentz method; step(j) gives a_j and b_j."""
    f = np.where(first == 0, _TINY, first)
    c, d, j = f.copy(), np.zeros_like(f), 0
    while j < 100_000:
        j += 1
        a, b = step(j)
        d = b + a * d
        d = 1 / np.where(d == 0, _TINY, d)
        c = b + a / c
        c = np.where(c == 0, _TINY, c)
        f = f * c * d
        if not (np.abs(c * d - 1) > _EPS).any():
            break
    return f


def _log_beta_lower(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """log I_x(a, b) for x up to about the mean."""
    n = a + b
    lead = stirling_error(n) - stirling_error(a) - stirling_error(b) - deviance(a, n * x) - deviance(b, n * (1 - x)) + 0.5 * (np.log(b) - np.log(n) - np.log(a)) - _HALF_LOG_2PI

    def step(j: int):
        if j == 1:
            return np.ones_like(x), np.ones_like(x)
        m, odd = divmod(j - 1, 2)
        up = -(a + m) * (n + m) / ((a + 2 * m) * (a + 2 * m + 1)) if odd else m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m))
        return up * x, np.ones_like(x)

    return lead + np.log(_fraction(np.zeros_like(x), step))


def log_beta(a, b, x) -> np.ndarray:
    """log of the regularised incomplete beta I_x(a, b), a and b above 0; NaN stays."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    out = np.full(x.shape, np.nan)
    out[x <= 0], out[x >= 1] = -np.inf, 0.0
    inside = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    low = inside & (x <= (a + 1) / (a + b + 2))
    high = inside & ~low
    if low.any():
        out[low] = np.minimum(_log_beta_lower(a[low], b[low], x[low]), 0.0)
    if high.any():
        with np.errstate(divide="ignore"):
            out[high] = np.log1p(-np.exp(np.minimum(_log_beta_lower(b[high], a[high], 1 - x[high]), 0.0)))
    out[np.isnan(a) | np.isnan(b) | np.isnan(x)] = np.nan
    return out


def log_gamma_upper(a, x) -> np.ndarray:
    """log of the regularised upper incomplete gamma Q(a, x), a above 0; NaN stays."""
    a, x = (np.array(v, float) for v in np.broadcast_arrays(a, x))
    out = np.full(x.shape, np.nan)
    out[x <= 0], out[np.isposinf(x)] = 0.0, -np.inf
    inside = (x > 0) & np.isfinite(x) & (a > 0)
    low = inside & (x < a + 1)
    high = inside & ~low
    lead = lambda a, x: -stirling_error(a) - deviance(a, x) - 0.5 * np.log(a) - _HALF_LOG_2PI  # x^a e^-x / Gamma(a + 1)
    if low.any():
        p, y = a[low], x[low]
        term, total, j = np.ones_like(y), np.ones_like(y), 0
        while (term > _EPS * total).any() and j < 100_000:
            j += 1
            term = term * y / (p + j)
            total = total + term
        with np.errstate(divide="ignore"):
            out[low] = np.log1p(-np.exp(np.minimum(lead(p, y) + np.log(total), 0.0)))
    if high.any():
        p, y = a[high], x[high]
        step = lambda j: (np.ones_like(y), y + 1 - p) if j == 1 else (-(j - 1) * (j - 1 - p), y + 2 * j - 1 - p)
        out[high] = lead(p, y) + np.log(p) + np.log(_fraction(np.zeros_like(y), step))
    out[np.isnan(a) | np.isnan(x)] = np.nan
    return out


def _over(f):
    """A pandas UDF of f over float arrays; nulls and NaN give null."""

    def run(*columns: Column) -> Column:
        @F.pandas_udf("double")
        def udf(*s: pd.Series) -> pd.Series:
            out = f(*(x.to_numpy(float, na_value=np.nan) for x in s))
            return pd.Series(out).where(~np.isnan(out), None)

        return udf(*[c.cast("double") for c in columns])

    return run


def _binomial(x: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    x, n = np.ceil(x), np.floor(n)
    inside = (x > 0) & (x <= n)
    out = -log_beta(np.where(inside, x, 1.0), np.where(inside, n - x + 1, 1.0), np.clip(p, 0, 1))
    out = np.where(x <= 0, 0.0, np.where(x > n, np.inf, out))
    out = np.where(np.isnan(x) | np.isnan(n) | np.isnan(p), np.nan, np.maximum(out, 0.0))
    return np.where(np.isposinf(out), np.finfo(float).max, out)


def binomial_tail(x: Column, n: Column, p: Column) -> Column:
    """-log P(X >= x) for X binomial with n trials; an impossible count gives the greatest finite double."""
    return _over(_binomial)(x, n, p)


def t_two_sided(t: Column, dof: Column) -> Column:
    """P(|T| >= |t|) for Student's t."""
    return _over(lambda t, v: np.exp(log_beta(v / 2, 0.5, np.where(np.isinf(t), 0.0, v / (v + t * t)))))(t, dof)


def t_upper(t: Column, dof: Column) -> Column:
    """P(T >= t) for Student's t."""
    two = t_two_sided(t, dof)
    return F.when(t >= 0, two / 2).otherwise(1 - two / 2)


def chi_square(chi: Column, dof: Column) -> Column:
    """P(X >= chi) for chi-square."""
    return _over(lambda x, k: np.exp(log_gamma_upper(k / 2, x / 2)))(chi, dof)


def normal_two_sided(z: Column) -> Column:
    return chi_square(z * z, F.lit(1.0))


def correlation(df: DataFrame, x: str, y: str, z: float = 1.959963984540054) -> DataFrame:
    """Pearson's r over rows that have both, its t, degrees of freedom, two-sided p and the interval by Fisher's transformation (null below 4 rows)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    out = df.filter(both).agg(F.corr(x, y).alias("r"), F.count("*").alias("n")).withColumn("dof", F.col("n") - 2)
    out = out.withColumn("t", F.col("r") * F.sqrt(F.col("dof") / (1 - F.col("r") * F.col("r"))))
    half = F.when(F.col("n") > 3, z / F.sqrt(F.col("n") - 3))
    return out.select("r", "n", "t", "dof", t_two_sided(F.col("t"), F.col("dof")).alias("p"), F.tanh(F.atanh("r") - half).alias("lo"), F.tanh(F.atanh("r") + half).alias("hi"))
