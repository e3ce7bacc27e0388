"""Statistical expressions and small solvers."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

EULER_GAMMA = 0.5772156649015329

# Rational approximation of the normal CDF (error below 1e-7).
CDF_SCALE = 0.2316419
CDF_COEFFICIENTS = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cdf(x: Column) -> Column:
    t = 1.0 / (1.0 + CDF_SCALE * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(CDF_COEFFICIENTS):
        poly = (poly + c) * t
    tail = F.exp(-x * x / 2.0) / math.sqrt(2.0 * math.pi) * poly
    return F.when(x >= 0, 1.0 - tail).otherwise(tail)


def correlation(x: Column | str, y: Column | str, over: WindowSpec | None = None) -> Column:
    """Pearson correlation of rows where both are known; NULL when either is constant."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    a, b = F.when(y.isNotNull(), x).cast("double"), F.when(x.isNotNull(), y).cast("double")
    parts = [F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)]
    cov, sx, sy = parts if over is None else [p.over(over) for p in parts]
    return F.when((sx > 1e-12) & (sy > 1e-12), F.try_divide(cov, sx * sy))


def two_sided_p(z: Column) -> Column:
    return 2.0 * (1.0 - normal_cdf(F.abs(z)))


def expected_max_sharpe(n_trials: int) -> float:
    """Expected best Sharpe of ``n_trials`` independent trials without skill; a single trial is no choice."""
    if n_trials < 2:
        return 0.0
    inv = NormalDist().inv_cdf
    return (1 - EULER_GAMMA) * inv(1 - 1 / n_trials) + EULER_GAMMA * inv(1 - 1 / (n_trials * math.e))


def deflated_sharpe(sharpe: Column, n_trials: int, skew: Column, kurt: Column, n_obs: Column) -> Column:
    """Probability that a Sharpe ratio is genuine after ``n_trials``; NULL where
    it cannot be computed.  ``kurt`` is the plain kurtosis (normal = 3)."""
    var = 1.0 - skew * sharpe + (kurt - 1.0) / 4.0 * sharpe * sharpe
    z = (sharpe - expected_max_sharpe(n_trials)) / F.sqrt(F.when(var > 0, var) / (n_obs - 1))
    return F.when(n_obs >= 2, normal_cdf(z))


def landis_koch(k: Column) -> Column:
    return (
        F.when(k.isNull() | F.isnan(k), "undefined")
        .when(k < 0, "poor")
        .when(k <= 0.20, "slight")
        .when(k <= 0.40, "fair")
        .when(k <= 0.60, "moderate")
        .when(k <= 0.80, "substantial")
        .otherwise("almost_perfect")
    )


def log_gamma_int(n: Column) -> Column:
    """ln((n-1)!) for a whole n >= 1, exact below 2, Stirling series above."""
    x = F.greatest(n.cast("double"), F.lit(1.0)) + 7.0
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x)
    shift = F.lit(0.0)
    for i in range(7):
        shift = shift + F.log(F.greatest(n.cast("double"), F.lit(1.0)) + i)
    return series - shift


# ---- solvers for one row per group (after a distributed aggregate) ---------------


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / max(abs(1 - (a + b) * x / (a + 1)), 1e-300) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    h = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / (1.0 + num * d)
            c = 1.0 + num / c
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h


def beta_quantile(q: float, a: float, b: float) -> float:
    """Inverse of :func:`beta_cdf` by bisection."""
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(mid, a, b) < q else (lo, mid)
    return (lo + hi) / 2


def gamma_tail(x: float, a: float) -> float:
    """Upper regularised incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - front * total
    b, c = x + 1 - a, 1e300
    d = h = 1.0 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t."""
    return pd.Series([beta_cdf(n / (n + x * x), n / 2, 0.5) if x == x and n > 0 else None for x, n in zip(t, df)], dtype=float)


def chi_square_p(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution."""
    return pd.Series([gamma_tail(v / 2, n / 2) if v == v and n > 0 else None for v, n in zip(x, df)], dtype=float)


def clopper_pearson(k: pd.Series, n: pd.Series, alpha: float = 0.05) -> pd.DataFrame:
    low = [0.0 if kk == 0 else beta_quantile(alpha / 2, kk, nn - kk + 1) for kk, nn in zip(k, n)]
    high = [1.0 if kk == nn else beta_quantile(1 - alpha / 2, kk + 1, nn - kk) for kk, nn in zip(k, n)]
    return pd.DataFrame({"low": low, "high": high})


def mean_vif(cov: np.ndarray) -> float:
    """Mean diagonal of the inverse correlation matrix; inf when singular."""
    sd = np.sqrt(np.diag(cov))
    if not np.all(sd > 0):
        return math.inf
    corr = cov / np.outer(sd, sd)
    if np.linalg.matrix_rank(corr, tol=1e-10) < len(corr):
        return math.inf
    return float(np.mean(np.diag(np.linalg.inv(corr))))
