"""Table and column profiles.

A profile is a handful of passes over the table, none of them per column:
one wide aggregate for counts and moments, the quantile passes, one pass for outlier
counts, and one shuffle of pre-counted (column, value) pairs for distinct counts and
top values. Only aggregate rows reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULTS, WIDE_AGG_COLUMNS, Thresholds
from ..functions.columns import as_double, batches, is_datetime, is_numeric, is_string, ref, types_of
from ..functions.counts import common_values, distinct_counts
from ..functions.leading import Leading, leading_values
from ..functions.parsing import parse_number, parse_timestamp
from ..functions.quantiles import exact_quantiles
from ..functions.stats import adjusted_skew, label_of_skew, skew_label
from .rows import count_duplicates

PROFILE_SCHEMA = (
    "column string, dtype string, type_category string, null_count bigint, null_percent double, "
    "unique_count bigint, sample_values array<string>, mean double, median double, std double, "
    "min double, max double, skewness double, skew_label string, outlier_count bigint, "
    "min_date timestamp_ntz, max_date timestamp_ntz, "
    "top_values array<struct<value:string,count:bigint>>, cardinality string"
)


@dataclass
class ColumnProfile:
    """Everything the rules need to know about one column."""

    column: str
    dtype: str = ""
    type_category: str = "categorical"
    null_count: int = 0
    null_percent: float | None = None
    unique_count: int | None = None
    sample_values: list[str] = field(default_factory=list)
    mean: float | None = None
    median: float | None = None
    std: float | None = None
    min: float | None = None
    max: float | None = None
    skewness: float | None = None
    skew_label: str | None = None
    outlier_count: int | None = None
    min_date: datetime | None = None
    max_date: datetime | None = None
    top_values: list[tuple[str, int]] | None = None
    cardinality: str | None = None


@dataclass
class Profile:
    """A table profile: its size, its duplicates, and its columns by name."""

    rows: int
    duplicate_rows: int | None
    columns: dict[str, ColumnProfile]

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [tuple(asdict(c).values()) for c in self.columns.values()]
        return spark.createDataFrame(rows, PROFILE_SCHEMA)


def null_mask(df: DataFrame, name: str) -> Column:
    """True where the value is missing; NaN is missing too."""
    dtype = types_of(df)[name]
    value = ref(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def table_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row: rows, columns, duplicate rows (first copies are not counted)."""
    width = F.lit(len(df.columns)).cast("bigint").alias("columns")
    if not df.columns:
        return df.agg(F.count("*").alias("rows")).select(
            "rows", width, F.lit(0).cast("bigint").alias("duplicate_rows")
        )
    if approx:
        return df.agg(
            F.count("*").alias("rows"),
            F.approx_count_distinct(F.struct("*"), 0.01).alias("_distinct"),
        ).select(
            "rows", width, F.greatest(F.col("rows") - F.col("_distinct"), F.lit(0)).alias("duplicate_rows")
        )
    copies = F.lit(count_duplicates(df)).cast("bigint").alias("duplicate_rows")
    return df.agg(F.count("*").alias("rows")).select("rows", width, copies)


def null_profile(df: DataFrame, digits: int = 2) -> DataFrame:
    """``(column, null_count, null_percent)``; an empty table has no percent."""
    columns = df.columns
    row = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(null_mask(df, c)).alias(f"n{i}") for i, c in enumerate(columns)],
    )
    pairs = [x for i, c in enumerate(columns) for x in (F.lit(c), F.col(f"n{i}"))]
    return row.select(
        "_rows", F.stack(F.lit(len(columns)), *pairs).alias("column", "null_count")
    ).select(
        "column",
        "null_count",
        F.round(F.try_divide(F.col("null_count") * 100.0, F.col("_rows")), digits).alias("null_percent"),
    )


@dataclass
class _Scalars:
    """Results of the wide aggregate for one column."""

    present: int = 0
    values: int = 0
    mean: float | None = None
    std: float | None = None
    min: float | None = None
    max: float | None = None
    skew: float | None = None
    min_date: datetime | None = None
    max_date: datetime | None = None


def _scalars(
    df: DataFrame, numbers: dict[str, Column], dates: dict[str, Column]
) -> tuple[int, dict[str, _Scalars]]:
    """Counts of all columns, moments of numbers, ranges of dates; one scan per batch."""
    total, found = 0, {}
    for group in batches(df.columns, WIDE_AGG_COLUMNS):
        aggs = [F.count("*").alias("rows")]
        for i, c in enumerate(group):
            aggs.append(F.count_if(~null_mask(df, c)).alias(f"p{i}"))
            if c in numbers:
                x = numbers[c]
                aggs += [
                    F.count(x).alias(f"n{i}"),
                    F.avg(x).alias(f"mean{i}"),
                    F.stddev_samp(x).alias(f"std{i}"),
                    F.min(x).alias(f"min{i}"),
                    F.max(x).alias(f"max{i}"),
                    adjusted_skew(x).alias(f"skew{i}"),
                ]
            elif c in dates:
                aggs += [F.min(dates[c]).alias(f"first{i}"), F.max(dates[c]).alias(f"last{i}")]
        row = df.agg(*aggs).first().asDict()
        total = row["rows"]
        for i, c in enumerate(group):
            found[c] = _Scalars(
                row[f"p{i}"],
                row.get(f"n{i}", 0),
                row.get(f"mean{i}"),
                row.get(f"std{i}"),
                row.get(f"min{i}"),
                row.get(f"max{i}"),
                row.get(f"skew{i}"),
                row.get(f"first{i}"),
                row.get(f"last{i}"),
            )
    return total, found


def fences(
    df: DataFrame,
    values: dict[str, Column],
    multiplier: float = DEFAULTS.iqr_multiplier,
    counts: dict[str, int] | None = None,
    with_median: bool = False,
) -> dict[str, tuple[float | None, float | None, float | None, float | None, float | None]]:
    """``(lower, upper, q1, median, q3)`` of each expression; the median on request."""
    probs = [0.25, 0.5, 0.75] if with_median else [0.25, 0.75]
    result = {}
    for name, quartiles in exact_quantiles(df, values, probs, counts).items():
        q1, q3 = quartiles[0], quartiles[-1]
        median = quartiles[1] if with_median else None
        if q1 is None:
            result[name] = (None, None, None, None, None)
        else:
            reach = multiplier * (q3 - q1)
            result[name] = (q1 - reach, q3 + reach, q1, median, q3)
    return result


def outside(value: Column, lower: float | None, upper: float | None) -> Column:
    """True for a value beyond the fences; a missing value is never an outlier."""
    if lower is None or upper is None:
        return F.lit(False)
    return F.coalesce((value < F.lit(lower)) | (value > F.lit(upper)), F.lit(False))


def count_outside(
    df: DataFrame, values: dict[str, Column], limits: dict[str, tuple]
) -> dict[str, int]:
    """Number of values beyond their fences, all columns in one pass."""
    counts: dict[str, int] = {}
    for group in batches(values, WIDE_AGG_COLUMNS):
        row = df.agg(
            *[
                F.count_if(outside(values[c], limits[c][0], limits[c][1])).alias(f"o{i}")
                for i, c in enumerate(group)
            ]
        ).first()
        counts.update({c: row[f"o{i}"] for i, c in enumerate(group)})
    return counts


def category_of(dtype: T.DataType, lead: Leading, limits: Thresholds) -> str:
    """Type category from the declared type and, for text, from its first values."""
    if is_numeric(dtype):
        return "numeric"
    if is_datetime(dtype):
        return "datetime"
    if is_string(dtype) and lead.count:
        if lead.numbers / lead.count > limits.numeric_share:
            return "should_be_numeric"
        if lead.dates / lead.count > limits.datetime_share:
            return "should_be_datetime"
    return "categorical"


def _rounded(value: float | None) -> float | None:
    return None if value is None else round(value, 4) + 0.0  # no negative zero


def profile(
    df: DataFrame,
    order_by: Sequence[str],
    approx: bool = False,
    duplicates: bool = True,
    limits: Thresholds = DEFAULTS,
    sample_only: bool = False,
) -> Profile:
    """Full profile. ``order_by`` names the row order used for samples and inference.

    ``approx`` counts distinct values and duplicates with sketches; everything else
    stays exact. ``sample_only`` takes the range of text dates from the first values
    that also decide the type, instead of the whole column.
    """
    types = types_of(df)
    lead = leading_values(df, order_by, df.columns, limits.inference_sample, limits.sample_values)
    categories = {c: category_of(types[c], lead[c], limits) for c in df.columns}

    numbers, dates = {}, {}
    for c, category in categories.items():
        if category == "numeric":
            numbers[c] = as_double(c)
        elif category == "should_be_numeric":
            numbers[c] = parse_number(ref(c))
        elif category == "datetime":
            dates[c] = ref(c).cast("timestamp_ntz")
        elif category == "should_be_datetime" and not sample_only:
            dates[c] = parse_timestamp(ref(c))

    if not df.columns:
        return Profile(df.count(), 0, {})
    rows, scalars = _scalars(df, numbers, dates)
    counts = {c: scalars[c].values for c in numbers}
    limits_of = fences(df, numbers, limits.iqr_multiplier, counts, with_median=True)
    outliers = count_outside(df, numbers, limits_of)
    unique, top = _values(df, categories, approx, limits)

    duplicate_rows = None
    if duplicates:
        if approx:
            duplicate_rows = table_profile(df, approx).first()["duplicate_rows"]
        else:
            duplicate_rows = count_duplicates(df)

    columns = {}
    for c in df.columns:
        category, s = categories[c], scalars[c]
        p = ColumnProfile(c, types[c].simpleString(), category)
        p.null_count = rows - s.present
        p.null_percent = round(100.0 * p.null_count / rows, 2) if rows else None
        p.unique_count = unique[c]
        p.sample_values = lead[c].samples
        if c in numbers:
            p.mean = _rounded(s.mean)
            p.median = _rounded(limits_of[c][3])
            p.skewness = _rounded(s.skew)
            if category == "numeric":
                p.std, p.min, p.max = _rounded(s.std), _rounded(s.min), _rounded(s.max)
                p.skew_label = label_of_skew(p.skewness, limits)
            else:
                p.skew_label = label_of_skew(s.skew, limits)
            p.outlier_count = outliers[c]
        elif c in dates:
            p.min_date, p.max_date = s.min_date, s.max_date
        elif category == "should_be_datetime":
            p.min_date, p.max_date = lead[c].first_date, lead[c].last_date
        else:
            p.top_values = top.get(c, [])
            p.cardinality = "high" if p.unique_count > limits.high_cardinality else "low"
        columns[c] = p
    return Profile(rows, duplicate_rows, columns)


def _values(
    df: DataFrame, categories: dict[str, str], approx: bool, limits: Thresholds
) -> tuple[dict[str, int], dict[str, list[tuple[str, int]]]]:
    """Distinct counts of all columns and top values of the categorical ones."""
    plain = [c for c, category in categories.items() if category == "categorical"]
    counted = plain if approx else list(categories)
    unique: dict[str, int] = {}
    top: dict[str, list[tuple[str, int]]] = {}
    if approx:
        unique = {r["column"]: r["unique_count"] for r in distinct_counts(df, approx=True).collect()}
    for c, common in common_values(df, counted, limits.top_values, plain).items():
        unique.setdefault(c, common.unique)
        top[c] = [(text, n) for _, text, n in common.top]
    return {c: unique.get(c, 0) for c in categories}, top


def column_profile(df: DataFrame, order_by: Sequence[str], **options) -> DataFrame:
    """The full profile as a table, one row per column."""
    return profile(df, order_by, duplicates=False, **options).to_df(df.sparkSession)


def numeric_profile(
    df: DataFrame, columns: Sequence[str] | None = None, limits: Thresholds = DEFAULTS
) -> DataFrame:
    """Moments, median, skew and outlier counts of numeric columns."""
    columns = [
        c for c in (columns if columns is not None else df.columns) if is_numeric(types_of(df)[c])
    ]
    return value_profile(df, {c: as_double(c) for c in columns}, limits)


def converted_profile(
    df: DataFrame, columns: Sequence[str], limits: Thresholds = DEFAULTS
) -> DataFrame:
    """The statistics text columns have once they are read as numbers."""
    stats = value_profile(df, {c: parse_number(ref(c)) for c in columns}, limits)
    return stats.select("column", "mean", "median", "skewness", "skew_label", "outlier_count")


def value_profile(
    df: DataFrame, values: dict[str, Column], limits: Thresholds = DEFAULTS
) -> DataFrame:
    """Numeric statistics of named expressions, one row each."""
    named = df.select(*[v.alias(f"x{i}") for i, v in enumerate(values.values())])
    inner = {name: F.col(f"x{i}") for i, name in enumerate(values)}
    limits_of = fences(named, inner, limits.iqr_multiplier, with_median=True)
    parts, aggs = [], [F.count("*").alias("rows")]
    for i, name in enumerate(values):
        x, (lower, upper, _, median, _) = F.col(f"x{i}"), limits_of[name]
        aggs.append(
            F.struct(
                F.lit(name).alias("column"),
                F.count_if(x.isNull()).alias("null_count"),
                F.avg(x).alias("mean"),
                F.lit(median).cast("double").alias("median"),
                F.stddev_samp(x).alias("std"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
                adjusted_skew(x).alias("skewness"),
                F.count_if(outside(x, lower, upper)).alias("outlier_count"),
            ).alias(f"s{i}")
        )
        parts.append(F.col(f"s{i}"))
    stats = named.agg(*aggs).select("rows", F.explode(F.array(*parts)).alias("s")).select("rows", "s.*")
    return stats.select(
        "column",
        "null_count",
        F.round(F.try_divide(F.col("null_count") * 100.0, F.col("rows")), 2).alias("null_percent"),
        *[F.round(c, 4).alias(c) for c in ("mean", "median", "std", "min", "max", "skewness")],
        skew_label(F.round("skewness", 4), limits).alias("skew_label"),
        "outlier_count",
    )


def summary_flags(columns: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """One row of name lists: many nulls, high skew, outliers. Input: a column profile."""

    def names(condition: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(condition, F.col("column"))))

    return columns.agg(
        names(F.col("null_percent") > limits.high_null_percent).alias("high_null_columns"),
        names(F.col("skew_label") == "high_skew").alias("high_skew_columns"),
        names(F.col("outlier_count") > 0).alias("outlier_columns"),
    )
