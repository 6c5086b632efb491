"""Distribution functions as Column expressions, and NumPy quantiles for pandas UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

# Rational approximation 7.1.26 of the error function in
# Abramowitz and Stegun, absolute error below 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    """Error function for x >= 0."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    poly = F.lit(ERF_A[4])
    for a in reversed(ERF_A[:4]):
        poly = poly * t + F.lit(a)
    return F.lit(1.0) - poly * t * F.exp(-x * x)


def chi2_cdf(x: Column, dist: str) -> Column:
    """CDF of chi-square with df '1' or '2', or '1.5' = their 50:50 mixture."""
    pos = F.greatest(x, F.lit(0.0))
    one = erf(F.sqrt(pos / F.lit(2.0)))
    two = F.lit(1.0) - F.exp(-pos / F.lit(2.0))
    value = {"1": one, "2": two, "1.5": F.lit(0.5) * one + F.lit(0.5) * two}[dist]
    return F.when(x.isNotNull(), F.when(x > 0, value).otherwise(F.lit(0.0)))


def student_t_cdf(t: Column, df: Column) -> Column:
    """P(T <= t) for whole degrees of freedom, by the finite trigonometric series."""
    nu = df.cast("int")
    theta = F.atan(t / F.sqrt(nu.cast("double")))
    cos2 = F.cos(theta) * F.cos(theta)
    odd = nu % 2 == 1
    terms = F.when(odd, (nu - 1) / 2).otherwise(nu / 2).cast("int")

    def series(first: Column, ratio) -> Column:
        start = F.struct(first.alias("term"), F.lit(0.0).alias("total"))
        return F.aggregate(
            F.sequence(F.lit(1), terms),
            start,
            lambda acc, k: F.struct(
                (acc["term"] * ratio(k.cast("double")) * cos2).alias("term"),
                (acc["total"] + acc["term"]).alias("total"),
            ),
            lambda acc: acc["total"],
        )

    odd_sum = F.when(terms >= 1, series(F.cos(theta), lambda k: 2 * k / (2 * k + 1))).otherwise(F.lit(0.0))
    odd_area = F.lit(2.0 / math.pi) * (theta + F.sin(theta) * odd_sum)
    even_area = F.sin(theta) * F.when(terms >= 1, series(F.lit(1.0), lambda k: (2 * k - 1) / (2 * k)))
    return F.lit(0.5) + F.when(odd, odd_area).otherwise(even_area) / F.lit(2.0)


def gamma_p(a: float, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma, series below a + 1 and continued fraction above."""
    x = np.asarray(x, float)
    out = np.zeros_like(x)
    low = (x > 0) & (x < a + 1)
    high = x >= a + 1
    if low.any():
        z = x[low]
        term = np.full_like(z, 1.0 / a)
        total = term.copy()
        for k in range(1, 500):
            term = term * z / (a + k)
            total += term
            if (term < 1e-17 * total).all():
                break
        out[low] = total * np.exp(-z + a * np.log(z) - math.lgamma(a))
    if high.any():
        z = x[high]
        b = z + 1 - a
        c = np.full_like(z, 1e300)
        d = 1 / b
        h = d.copy()
        for k in range(1, 300):
            an = -k * (k - a)
            b = b + 2
            d = 1 / (an * d + b)
            c = b + an / c
            step = d * c
            h = h * step
            if (np.abs(step - 1) < 1e-16).all():
                break
        out[high] = 1 - np.exp(-z + a * np.log(z) - math.lgamma(a)) * h
    return out


def chi2_quantile(p: np.ndarray, df: float) -> np.ndarray:
    """Chi-square quantiles for any positive df: Newton steps kept inside a shrinking bracket."""
    p = np.asarray(p, float)
    a = df / 2
    cut = 2 / (9 * df)
    z = _normal_quantile(p)
    start = df * (1 - cut + z * np.sqrt(cut)) ** 3
    small = 2 * np.exp((np.log(np.maximum(p, 1e-300)) + math.lgamma(a + 1)) / a)
    x = np.where((start < 0.3 * df) | ~np.isfinite(start), small, start)
    lo, hi = np.zeros_like(p), np.full_like(p, np.inf)
    for _ in range(60):
        gap = gamma_p(a, x / 2) - p
        lo, hi = np.where(gap < 0, np.maximum(lo, x), lo), np.where(gap >= 0, np.minimum(hi, x), hi)
        with np.errstate(all="ignore"):
            density = np.exp((a - 1) * np.log(x / 2) - x / 2 - math.lgamma(a)) / 2
            new = x - gap / density
        bad = ~((new > lo) & (new < hi))
        new = np.where(bad, np.where(np.isfinite(hi), (lo + hi) / 2, 2 * x + 1), new)
        done = np.abs(new - x) <= 1e-13 * np.maximum(new, 1e-300)
        x = new
        if done.all():
            break
    return np.where(p <= 0, 0.0, x)


# Rational approximation 26.2.23 of the normal quantile in
# Abramowitz and Stegun, a starting point good to 4.5e-4.
NORMAL_C = (2.515517, 0.802853, 0.010328)
NORMAL_D = (1.432788, 0.189269, 0.001308)


def _normal_quantile(p: np.ndarray) -> np.ndarray:
    tail = np.clip(np.minimum(p, 1 - p), 1e-300, 0.5)
    t = np.sqrt(-2 * np.log(tail))
    top = NORMAL_C[0] + t * (NORMAL_C[1] + t * NORMAL_C[2])
    bottom = 1 + t * (NORMAL_D[0] + t * (NORMAL_D[1] + t * NORMAL_D[2]))
    return np.where(p < 0.5, top / bottom - t, t - top / bottom)


def chi2_quantile_column(p: Column, df: float) -> Column:
    """Closed form for df 2; otherwise an Arrow UDF over `chi2_quantile`."""
    if df == 2:
        return F.lit(-2.0) * F.log(F.lit(1.0) - p)

    @F.pandas_udf("double")
    def quantile(values: pd.Series) -> pd.Series:
        return pd.Series(chi2_quantile(values.to_numpy(), df))

    return quantile(p)


def gamma_cdf_column(x: Column, df: float) -> Column:
    """P(X <= x) for a chi-square X with any positive number of degrees of freedom."""

    @F.pandas_udf("double")
    def cdf(values: pd.Series) -> pd.Series:
        return pd.Series(gamma_p(df / 2, values.to_numpy(float) / 2))

    return cdf(x)
