"""Null strategies and fills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULTS, Thresholds
from ..functions.columns import as_double, is_datetime, ref, require_columns, types_of
from ..functions.counts import modes
from ..functions.quantiles import exact_quantiles
from . import ordered
from .profile import Profile, null_mask

FILLS = ("fill_mean", "fill_median", "fill_mode", "fill_forward")
STRATEGIES = (*FILLS, "drop_rows", "drop_column")


def null_strategy(columns: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """Add ``strategy`` to rows of (null_percent, type_category, skew_label, ...)."""
    category = F.col("type_category")
    skewed = F.coalesce(F.col("skew_label"), F.lit("symmetric")).isin("moderate_skew", "high_skew")
    return columns.withColumn(
        "strategy",
        F.when(F.col("null_percent") > limits.drop_column_percent, "drop_column")
        .when((category == "numeric") & skewed, "fill_median")
        .when(category == "numeric", "fill_mean")
        .when(category == "categorical", "fill_mode")
        .when(category == "datetime", "fill_forward")
        .otherwise("drop_rows"),
    )


def replace_null(df: DataFrame, column: str, value: object) -> Column:
    """The column with its missing values replaced by a statistic; None changes nothing."""
    if value is None:
        return ref(column)
    dtype = types_of(df)[column]
    if isinstance(value, float) and not isinstance(dtype, T.DecimalType):
        return F.coalesce(as_double(column), F.lit(value))
    return F.when(null_mask(df, column), F.lit(value).cast(dtype)).otherwise(ref(column))


def _replace(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    return df.select(*[changes.get(c, ref(c)).alias(c) for c in df.columns])


def fill_mean(df: DataFrame, column: str) -> DataFrame:
    require_columns(df, [column])
    mean = df.agg(F.avg(as_double(column))).first()[0]
    return _replace(df, {column: replace_null(df, column, mean)})


def fill_median(df: DataFrame, column: str) -> DataFrame:
    """Fill with the exact, interpolated median."""
    require_columns(df, [column])
    median = exact_quantiles(df, {column: as_double(column)}, [0.5])[column][0]
    return _replace(df, {column: replace_null(df, column, median)})


def fill_mode(df: DataFrame, column: str) -> DataFrame:
    """Fill with the most frequent value, the smallest of them on ties."""
    require_columns(df, [column])
    return _replace(df, {column: replace_null(df, column, modes(df, [column])[column])})


def fill_forward(
    df: DataFrame, column: str, order_by: Sequence[str], partition_by: Sequence[str] = (), **options
) -> DataFrame:
    require_columns(df, [column, *order_by, *partition_by])
    return ordered.forward_fill(df, column, order_by, partition_by, **options)


def drop_column(df: DataFrame, column: str) -> DataFrame:
    require_columns(df, [column])
    return df.drop(ref(column))


def drop_null_rows(df: DataFrame, column: str) -> DataFrame:
    require_columns(df, [column])
    return df.filter(~null_mask(df, column))


def auto_nulls(
    df: DataFrame,
    profile: Profile,
    order_by: Sequence[str],
    strategies: dict[str, str] | None = None,
    limits: Thresholds = DEFAULTS,
):
    """Treat every column with nulls, in column order, by its profile.

    ``strategies`` replaces the automatic choice and its order (N9). Returns the table
    and the log of ``plans.execute``.
    """
    from ..plans.execute import Action, run_actions

    if strategies is None:
        chosen = null_strategy(profile.to_df(df.sparkSession), limits).filter(
            F.col("null_count") > 0
        )
        found = {r["column"]: r["strategy"] for r in chosen.select("column", "strategy").collect()}
        strategies = {c: found[c] for c in profile.columns if c in found}
    actions = [Action(i, "nulls", c, s) for i, (c, s) in enumerate(strategies.items())]
    return run_actions(df, actions, order_by, limits)


def fits(action: str, dtype: T.DataType) -> bool:
    """Whether a fill makes sense for the type: no mean of text, no mode of a structure."""
    if action in ("fill_mean", "fill_median"):
        return isinstance(dtype, T.NumericType)
    if action == "fill_mode":
        return isinstance(dtype, (T.NumericType, T.StringType, T.BooleanType)) or is_datetime(dtype)
    return True
