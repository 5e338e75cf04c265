"""Aggregate expressions and small formulas over aggregate rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULTS, Thresholds


def adjusted_skew(value: Column) -> Column:
    """Bias-adjusted sample skewness; 0 for a constant, NULL below three values."""
    n = F.count(value).cast("double")
    correction = F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n >= 3, F.coalesce(F.skewness(value) * correction, F.lit(0.0)))


def skew_label(skew: Column, limits: Thresholds = DEFAULTS) -> Column:
    """A missing skew compares false everywhere and so counts as high."""
    size = F.abs(skew)
    return (
        F.when(size < limits.skew_symmetric, "symmetric")
        .when(size < limits.skew_moderate, "moderate_skew")
        .otherwise("high_skew")
    )


def label_of_skew(skew: float | None, limits: Thresholds = DEFAULTS) -> str:
    """``skew_label`` for a statistic that is already on the driver."""
    if skew is not None and abs(skew) < limits.skew_symmetric:
        return "symmetric"
    if skew is not None and abs(skew) < limits.skew_moderate:
        return "moderate_skew"
    return "high_skew"


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 1000):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return total


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (
        math.lgamma(a + b)
        - math.lgamma(a)
        - math.lgamma(b)
        + a * math.log(x)
        + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def correlation_p_value(r: float, n: int) -> float:
    """Two-sided p-value of a Pearson correlation over ``n`` complete pairs."""
    if n <= 2:
        return 1.0
    return incomplete_beta((n - 2) / 2.0, 0.5, max(0.0, 1.0 - r * r))
