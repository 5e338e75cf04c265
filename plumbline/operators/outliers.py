"""Outlier masks and fixes (O1-O7). A missing value is never an outlier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Thresholds
from ..functions.columns import as_double, is_numeric, ref, types_of
from .profile import Profile, fences, outside


def capped(value: Column, lower: float | None, upper: float | None) -> Column:
    """The value moved onto the nearer fence when it lies outside; NULL stays NULL."""
    if lower is None or upper is None:
        return value
    bounded = F.least(F.greatest(value, F.lit(lower)), F.lit(upper))
    return F.when(value.isNotNull(), bounded)


def flag_iqr(
    df: DataFrame,
    column: str,
    name: str = "is_outlier",
    multiplier: float = DEFAULTS.iqr_multiplier,
) -> DataFrame:
    """Add a flag for values beyond the interquartile fences."""
    value = as_double(column)
    lower, upper = fences(df, {column: value}, multiplier)[column][:2]
    return df.withColumn(name, outside(value, lower, upper))


def flag_zscore(
    df: DataFrame,
    column: str,
    name: str = "is_outlier",
    threshold: float = DEFAULTS.z_threshold,
) -> DataFrame:
    """Add a flag for values far from the mean in standard deviations."""
    value = as_double(column)
    mean, std = df.agg(F.avg(value), F.stddev_samp(value)).first()
    if not std:
        return df.withColumn(name, F.lit(False))
    score = F.abs((value - F.lit(mean)) / F.lit(std))
    return df.withColumn(name, F.coalesce(score > threshold, F.lit(False)))


def cap_outliers(
    df: DataFrame, columns: str | Sequence[str], multiplier: float = DEFAULTS.iqr_multiplier
) -> DataFrame:
    """Move outliers onto the fences; the columns become double."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    values = {c: as_double(c) for c in columns}
    limits = fences(df, values, multiplier)
    fixed = {c: capped(v, *limits[c][:2]) for c, v in values.items()}
    return df.select(*[fixed.get(c, ref(c)).alias(c) for c in df.columns])


def drop_outliers(
    df: DataFrame, column: str, multiplier: float = DEFAULTS.iqr_multiplier
) -> DataFrame:
    """Remove rows whose value is an outlier; rows without a value stay."""
    value = as_double(column)
    lower, upper = fences(df, {column: value}, multiplier)[column][:2]
    return df.filter(~outside(value, lower, upper))


def outlier_strategy(columns: DataFrame, rows: int, limits: Thresholds = DEFAULTS) -> DataFrame:
    """Drop rare outliers of a large enough table, cap the others."""
    rare = F.col("outlier_count") / F.lit(float(max(rows, 1))) < limits.outlier_drop_share
    large = F.lit(rows > limits.outlier_drop_min_rows)
    return columns.filter(F.col("outlier_count") > 0).withColumn(
        "strategy", F.when(rare & large, "drop").otherwise("cap")
    )


def auto_outliers(
    df: DataFrame,
    profile: Profile,
    strategy: str = "cap",
    strategies: dict[str, str] | None = None,
    order_by: Sequence[str] = (),
    limits: Thresholds = DEFAULTS,
):
    """One strategy for all numeric columns with outliers (O5), or one per column.

    Returns the table and the log of ``plans.execute``.
    """
    from ..plans.execute import Action, run_actions

    if strategies is None:
        types = types_of(df)
        strategies = {
            c: strategy
            for c, p in profile.columns.items()
            if c in types and is_numeric(types[c]) and (p.outlier_count or 0) > 0
        }
    actions = [Action(i, "outliers", c, s) for i, (c, s) in enumerate(strategies.items())]
    return run_actions(df, actions, order_by, limits)
