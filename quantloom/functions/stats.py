"""Distribution functions for test statistics.

Chi-square tails with an even number of degrees of freedom and the Kolmogorov tail are closed column expressions.
The normal and Student-t tails need functions Spark does not have; they are small Arrow batch functions applied to
aggregated rows only.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from quantloom.functions.scalar import col, div

# Standard normal quantiles used for interval and value-at-risk levels.
Z_ONE_SIDED = {0.90: 1.2815515655446004, 0.95: 1.6448536269514722, 0.975: 1.959963984540054, 0.99: 2.3263478740408408}


def normal_density(z: float) -> float:
    return math.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def normal_tail(z) -> Column:
    """P(|Z| > |z|)."""
    @F.pandas_udf("double")
    def f(z: pd.Series) -> pd.Series:
        return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)), na_action="ignore")
    return f(col(z))


def normal_quantile(p) -> Column:
    @F.pandas_udf("double")
    def f(p: pd.Series) -> pd.Series:
        from statistics import NormalDist
        return p.map(lambda v: NormalDist().inv_cdf(v) if 0 < v < 1 else np.nan, na_action="ignore")
    return f(col(p))


def student_tail(t, dof) -> Column:
    """P(|T| > |t|): integral of the density over the substituted angle, a smooth integrand on a finite range."""
    @F.pandas_udf("double")
    def f(t: pd.Series, n: pd.Series) -> pd.Series:
        nodes, weights = np.polynomial.legendre.leggauss(200)
        tv, nv = np.abs(t.to_numpy(float)), n.to_numpy(float)
        low = np.arctan(tv / np.sqrt(nv))
        half = (math.pi / 2 - low) / 2
        angle = low[:, None] + half[:, None] * (nodes[None, :] + 1)
        body = np.cos(angle) ** (nv[:, None] - 1)
        scale = np.array([math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(math.pi)
                          if v > 0 else np.nan for v in nv])
        return pd.Series(np.minimum(2 * scale * half * (body @ weights), 1.0))
    return F.when(col(t).isNotNull() & (col(dof) > 0), f(col(t).cast("double"), col(dof).cast("double")))


def chi2_tail_even(x, dof: int) -> Column:
    """P(X > x) for an even number of degrees of freedom: a Poisson sum."""
    if dof % 2:
        raise ValueError("closed form needs an even number of degrees of freedom")
    h, term, total = col(x) / 2, F.lit(1.0), F.lit(1.0)
    for k in range(1, dof // 2):
        term = term * h / k
        total = total + term
    return F.exp(-h) * total


def chi2_tail_odd(x, dof: int) -> Column:
    """P(X > x) for an odd number of degrees of freedom: the normal tail plus a finite sum."""
    x = col(x)
    total, term = F.lit(0.0), None
    for k in range(1, (dof - 1) // 2 + 1):
        term = F.sqrt(x) if k == 1 else term * x / (2 * k - 1)
        total = total + term
    return normal_tail(F.sqrt(x)) + math.sqrt(2 / math.pi) * F.exp(-x / 2) * total


def kolmogorov_tail(lam) -> Column:
    """Asymptotic P(K > lam), truncated to [0, 1]."""
    lam = col(lam)
    total = F.lit(0.0)
    for k in range(1, 51):
        total = total + (2.0 if k % 2 else -2.0) * F.exp(-2.0 * k * k * lam * lam)
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def unbiased_skewness(x) -> Column:
    """Aggregate: population skewness with the small-sample correction; null below three values."""
    n = F.count(col(x))
    return F.when(n > 2, F.skewness(col(x)) * div(F.sqrt(n * (n - 1).cast("double")), n - 2))


def unbiased_kurtosis(x) -> Column:
    n = F.count(col(x)).cast("double")
    return F.when(n > 3, (F.kurtosis(col(x)) * (n + 1) + 6) * div(n - 1, (n - 2) * (n - 3)))


# ---- gamma functions as column expressions, for x > 0 -----------------------------------------------------------------------
#: Bernoulli numbers B2, B4, ... of the asymptotic series.
BERNOULLI = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730, 7 / 6)
_SHIFT = 8      # the series is used beyond it, smaller arguments come from the recurrence


def log_gamma(x) -> Column:
    x = col(x)
    z = x + _SHIFT
    low = F.lit(1.0)
    for k in range(_SHIFT):
        low = low * (x + k)
    tail = F.lit(0.0)
    for k, b in enumerate(BERNOULLI, 1):
        tail = tail + b / (2 * k * (2 * k - 1)) / F.pow(z, 2 * k - 1)
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + tail - F.ln(low)


def digamma(x) -> Column:
    x = col(x)
    z = x + _SHIFT
    low, tail = F.lit(0.0), F.lit(0.0)
    for k in range(_SHIFT):
        low = low + 1 / (x + k)
    for k, b in enumerate(BERNOULLI, 1):
        tail = tail + b / (2 * k) / F.pow(z, 2 * k)
    return F.ln(z) - 1 / (2 * z) - tail - low


def trigamma(x) -> Column:
    x = col(x)
    z = x + _SHIFT
    low, tail = F.lit(0.0), F.lit(0.0)
    for k in range(_SHIFT):
        low = low + 1 / ((x + k) * (x + k))
    for k, b in enumerate(BERNOULLI, 1):
        tail = tail + b / F.pow(z, 2 * k + 1)
    return 1 / z + 1 / (2 * z * z) + tail + low
