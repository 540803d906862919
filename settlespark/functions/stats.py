"""Student's t distribution as columns, and the statistics of importances."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cdf_terms(df: int) -> list[float]:
    """Coefficients of the finite series for an integer number of degrees of freedom."""
    terms = [1.0]
    start = 1 if df % 2 == 0 else 2
    while len(terms) < (df // 2 if df % 2 == 0 else (df - 1) // 2):
        k = start + 2 * (len(terms) - 1)
        terms.append(terms[-1] * k / (k + 1))
    return terms


def t_cdf(t: Column, df: int) -> Column:
    """P(T <= t) for integer ``df``, a finite sum of powers of cos²(atan(t/√df))."""
    if df < 1:
        raise ValueError("degrees of freedom must be at least 1")
    cos2 = F.lit(1.0) / (F.lit(1.0) + t * t / F.lit(float(df)))
    series = F.lit(0.0)
    for c in reversed(_cdf_terms(df)):
        series = series * cos2 + F.lit(c)
    ratio = t / F.sqrt(F.lit(float(df)) + t * t)
    if df % 2 == 0:
        return F.lit(0.5) + ratio * series / 2
    angle = F.atan(t / F.lit(math.sqrt(df)))
    if df == 1:
        return F.lit(0.5) + angle / F.lit(math.pi)
    return F.lit(0.5) + (angle + ratio * F.sqrt(cos2) * series) / F.lit(math.pi)


def _t_cdf(t: float, df: int) -> float:
    cos2 = 1.0 / (1.0 + t * t / df)
    series = 0.0
    for c in reversed(_cdf_terms(df)):
        series = series * cos2 + c
    ratio = t / math.sqrt(df + t * t)
    if df % 2 == 0:
        return 0.5 + ratio * series / 2
    angle = math.atan(t / math.sqrt(df))
    tail = 0.0 if df == 1 else ratio * math.sqrt(cos2) * series
    return 0.5 + (angle + tail) / math.pi


def t_quantile(p: float, df: int) -> float:
    """The ``p`` quantile, by bisection on the cumulative function."""
    low, high = 0.0, 1.0
    while _t_cdf(high, df) < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _t_cdf(middle, df) < p else (low, middle)
    return (low + high) / 2


def importance_stats(
    table: DataFrame, n: int, mean: str = "importance", sd: str = "stddev", level: float = 0.99
) -> DataFrame:
    """Add the one-sided p value of a mean over ``n`` repeats and its confidence limits.

    Without spread the p value is 0.5, 0 or 1 for a zero, positive or negative mean.
    """
    if n < 2:
        raise ValueError("importance statistics need at least 2 repeats")
    error = F.col(sd) / F.lit(math.sqrt(n))
    spread = F.lit(t_quantile((1 + level) / 2, n - 1)) * error
    # nullif keeps the branch for zero spread from dividing by zero
    t = F.col(mean) / F.nullif(error, F.lit(0.0))
    flat = F.when(F.col(mean) > 0, 0.0).when(F.col(mean) < 0, 1.0).otherwise(0.5)
    percent = f"p{level * 100:g}"
    return table.withColumns({
        "p_value": F.when(F.col(sd) == 0, flat).otherwise(F.lit(1.0) - t_cdf(t, n - 1)),
        "n": F.lit(n),
        f"{percent}_high": F.col(mean) + spread,
        f"{percent}_low": F.col(mean) - spread,
    })
