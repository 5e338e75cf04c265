"""Type inference and type fixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import BROADCAST_ROWS, DEFAULTS, Thresholds
from ..functions.columns import ref, require_columns, string_columns
from ..functions.counts import distinct_counts
from ..functions.leading import leading_values
from ..functions.parsing import parse_number, parse_timestamp
from .joins import attach
from .ordered import row_numbers

ISSUE_SCHEMA = "column string, issue string"


def detect_type_issues(
    df: DataFrame,
    order_by: Sequence[str],
    limits: Thresholds = DEFAULTS,
    approx: bool = False,
) -> DataFrame:
    """``(column, issue)`` for text columns that hold numbers, dates or few values.

    Numbers and dates are judged on the first non-null values; few values means a small
    ratio of distinct values to rows, NULL rows included.
    """
    texts = string_columns(df)
    lead = leading_values(df, order_by, texts, limits.inference_sample)
    issues: dict[str, str] = {}
    for c in texts:
        if lead[c].count and lead[c].numbers / lead[c].count > limits.numeric_share:
            issues[c] = "should_be_numeric"
        elif lead[c].count and lead[c].dates / lead[c].count > limits.datetime_share:
            issues[c] = "should_be_datetime"
    open_columns = [c for c in texts if c not in issues]
    if open_columns:
        rows = df.count()
        for r in distinct_counts(df, open_columns, approx).collect():
            if rows and r["unique_count"] / rows < limits.categorical_ratio:
                issues[r["column"]] = "should_be_categorical"
    return df.sparkSession.createDataFrame(
        [(c, issues[c]) for c in texts if c in issues], ISSUE_SCHEMA
    )


def to_numeric(df: DataFrame, column: str) -> DataFrame:
    """Text as double; unreadable values become NULL."""
    return apply_type_fixes(df, {column: "should_be_numeric"})


def to_datetime(df: DataFrame, column: str) -> DataFrame:
    """Text as timestamp in any of the known patterns; unreadable values become NULL."""
    return apply_type_fixes(df, {column: "should_be_datetime"})


def to_categorical(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Add the zero-based position of each value among the sorted distinct values."""
    require_columns(df, [column])
    name = name or f"{column}_code"
    sizes = df.groupBy(ref(column)).agg(F.count("*").alias("count"))
    values = sizes.filter(ref(column).isNotNull()).select(ref(column))
    if values.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        # At most BROADCAST_ROWS distinct values reach this window.
        codes = values.withColumn(name, F.row_number().over(W.orderBy(ref(column))))
    else:
        codes = row_numbers(values, [column], name=name)
    codes = codes.withColumn(name, (F.col(name) - 1).cast("int"))
    return attach(df, column, codes, name, sizes)


def apply_type_fixes(df: DataFrame, fixes: dict[str, str]) -> DataFrame:
    """Apply a set of type fixes in one projection; unknown issue names are ignored."""
    require_columns(df, list(fixes))
    changed = {}
    for column, issue in fixes.items():
        if issue == "should_be_numeric":
            changed[column] = parse_number(ref(column).cast("string"))
        elif issue == "should_be_datetime":
            changed[column] = parse_timestamp(ref(column).cast("string"))
    if changed:
        df = df.select(
            *[(changed[c] if c in changed else ref(c)).alias(c) for c in df.columns]
        )
    for column, issue in fixes.items():
        if issue == "should_be_categorical":
            df = to_categorical(df, column)
    return df
