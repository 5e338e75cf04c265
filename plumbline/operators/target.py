"""Analysis of a target column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULTS, Thresholds
from ..functions.columns import as_double, fresh, is_numeric, ref, require_columns, types_of
from ..functions.correlations import correlations
from ..functions.counts import bounded_distinct
from ..functions.stats import correlation_p_value
from .joins import attach
from .profile import numeric_profile


def task_type(df: DataFrame, target: str, limits: Thresholds = DEFAULTS) -> str:
    """``classification`` for a non-numeric target or one with few values."""
    require_columns(df, [target])
    if not is_numeric(types_of(df)[target]):
        return "classification"
    few = bounded_distinct(df, [target], limits.classification_max_distinct)[target]
    return "classification" if few is not None else "regression"


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """``(class, count)`` of non-null classes, most frequent first."""
    return (
        df.filter(ref(target).isNotNull())
        .groupBy(ref(target).alias("class"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "class")
    )


def class_balance(df: DataFrame, target: str, limits: Thresholds = DEFAULTS) -> DataFrame:
    """One row: number of classes, ratio of smallest to largest, and its label."""
    ratio = F.col("ratio")
    return (
        class_distribution(df, target)
        .agg(
            F.count("*").alias("n_classes"),
            F.try_divide(F.min("count"), F.max("count")).cast("double").alias("ratio"),
        )
        .select(
            "n_classes",
            "ratio",
            F.when(F.col("n_classes") < 2, "single_class")
            .when(ratio >= limits.balanced, "balanced")
            .when(ratio >= limits.slightly_imbalanced, "slightly_imbalanced")
            .when(ratio >= limits.imbalanced, "imbalanced")
            .otherwise("severely_imbalanced")
            .alias("class_balance"),
        )
    )


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """``(class, count, weight, positive_ratio)``: weight = rows / (classes * count).

    ``positive_ratio`` is the first class's count over the second's, in sorted order,
    and only given for two classes.
    """
    counts = class_distribution(df, target)
    total = counts.agg(
        F.count("*").alias("k"),
        F.sum("count").alias("n"),
        F.min_by("count", "class").alias("negative"),
        F.max_by("count", "class").alias("positive"),
    ).first()
    ratio = total["negative"] / total["positive"] if total["k"] == 2 else None
    return counts.select(
        "class",
        "count",
        (F.lit(float(total["n"] or 0)) / (F.lit(float(total["k"])) * F.col("count"))).alias("weight"),
        F.lit(ratio).cast("double").alias("positive_ratio"),
    )


def weighted_rows(df: DataFrame, target: str, name: str = "class_weight") -> DataFrame:
    """The table with its class weight per row."""
    weights = class_weights(df, target)
    sizes = weights.select(F.col("class").alias(target), "count")
    lookup = weights.select(F.col("class").alias(target), F.col("weight").alias(name))
    return attach(df, target, lookup, name, sizes)


def regression_summary(df: DataFrame, target: str, limits: Thresholds = DEFAULTS) -> DataFrame:
    return numeric_profile(df, [target], limits).select(
        F.col("column").alias("target"), "mean", "median", "std", "skewness", "skew_label"
    )


def log_target(df: DataFrame, target: str, name: str | None = None) -> DataFrame:
    """Add log(1 + target)."""
    return df.withColumn(name or f"{target}_log", F.log1p(as_double(target)))


def unlog_target(df: DataFrame, column: str, name: str) -> DataFrame:
    """Back from log(1 + x)."""
    return df.withColumn(name, F.expm1(ref(column)))


def _target_value(df: DataFrame, target: str) -> Column | None:
    """The target as a number; a two-class text target becomes 0 and 1."""
    dtype = types_of(df)[target]
    if is_numeric(dtype):
        return as_double(target)
    if isinstance(dtype, T.BooleanType):
        return ref(target).cast("double")
    if bounded_distinct(df, [target], 2)[target] != 2:
        return None
    upper = df.agg(F.max(ref(target))).first()[0]
    return (ref(target) == F.lit(upper)).cast("double")


def feature_correlations(
    df: DataFrame, target: str, limits: Thresholds = DEFAULTS, digits: int = 4
) -> DataFrame:
    """Pearson correlation of each numeric feature with the target, strongest first.

    All correlations come from one pass over pairwise complete rows, however many columns there are.
    """
    require_columns(df, [target])
    spark = df.sparkSession
    schema = "column string, pairs bigint, correlation double, p_value double, significant boolean"
    goal = _target_value(df, target)
    features = {
        c: as_double(c) if is_numeric(t) else ref(c).cast("double")
        for c, t in types_of(df).items()
        if c != target and (is_numeric(t) or isinstance(t, T.BooleanType))
    }
    if goal is None:
        return spark.createDataFrame([], schema)
    rows = []
    goal_name = fresh(df, "_goal")
    for _, c, n, r in correlations(df, {goal_name: goal} | features, [goal_name]):
        if c == goal_name or n < limits.correlation_min_rows:
            continue
        if r is None:
            rows.append((c, n, None, None, None))
        else:
            p = correlation_p_value(r, n)
            rows.append((c, n, round(r, digits) + 0.0, round(p, digits), p < limits.alpha))
    rows.sort(key=lambda r: (-(abs(r[2]) if r[2] is not None else -1.0), r[0]))
    return spark.createDataFrame(rows, schema)


def target_summary(df: DataFrame, target: str, limits: Thresholds = DEFAULTS) -> DataFrame:
    """One row: task type and the numbers that go with it."""
    task = task_type(df, target, limits)
    if task == "classification":
        return class_balance(df, target, limits).select(
            F.lit(target).alias("target"), F.lit(task).alias("task_type"), "n_classes", "class_balance"
        )
    return regression_summary(df, target, limits).select(
        "target", F.lit(task).alias("task_type"), "mean", "median", "std", "skewness", "skew_label"
    )
