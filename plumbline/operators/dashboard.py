"""Aggregate tables behind an exploratory dashboard (V1-V7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULTS, WIDE_AGG_COLUMNS, Thresholds
from ..functions.columns import as_double, batches, fresh, is_numeric, numeric_columns, ref, types_of
from ..functions.correlations import correlations
from ..functions.counts import most_frequent
from .ordered import row_numbers
from .profile import Profile, fences, null_mask, outside


def _ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float, int]]:
    found = {}
    for group in batches(columns, WIDE_AGG_COLUMNS):
        row = df.agg(
            *[
                F.struct(F.min(_finite(c)), F.max(_finite(c)), F.count(_finite(c))).alias(f"r{i}")
                for i, c in enumerate(group)
            ]
        ).first()
        found.update({c: tuple(row[f"r{i}"]) for i, c in enumerate(group)})
    return found


def _finite(column: str) -> Column:
    x = as_double(column)
    return F.when(F.abs(x) < float("inf"), x)


def histogram(df: DataFrame, columns: Sequence[str] | None = None, nbins: int = 20) -> DataFrame:
    """``(column, bin, low, high, count)`` of equal-width bins; the last one is closed.

    Rows are counted per bin before the shuffle, so it moves at most one row per bin
    and task. Infinite values are in no bin.
    """
    columns = list(columns if columns is not None else numeric_columns(df))
    ranges = {c: r for c, r in _ranges(df, columns).items() if r[2]}
    if not ranges:
        schema = "column string, bin int, low double, high double, count bigint"
        return df.sparkSession.createDataFrame([], schema)
    arguments = [F.lit(len(ranges))]
    for c, (low, high, _) in ranges.items():
        x, width = _finite(c), (high - low) / nbins
        if width > 0:
            step = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(nbins - 1))
        else:
            step = F.lit(0)
        arguments += [
            F.lit(c),
            F.when(x.isNotNull(), step).cast("int"),
            F.lit(low),
            F.lit(width),
        ]
    return (
        df.select(F.stack(*arguments).alias("column", "bin", "_low", "_width"))
        .filter(F.col("bin").isNotNull())
        .groupBy("column", "bin", "_low", "_width")
        .agg(F.count("*").alias("count"))
        .select(
            "column",
            "bin",
            (F.col("_low") + F.col("bin") * F.col("_width")).alias("low"),
            (F.col("_low") + (F.col("bin") + 1) * F.col("_width")).alias("high"),
            "count",
        )
    )


def density(
    df: DataFrame, column: str, grid: int = 100, nbins: int = 200, limits: Thresholds = DEFAULTS
) -> DataFrame:
    """``(column, x, density)``: Gaussian kernel estimate over the binned column.

    Bandwidth by Scott's rule. Only the bins, one short array, meet the grid points.
    """
    x = as_double(column)
    n, std, low, high = df.agg(F.count(x), F.stddev_samp(x), F.min(x), F.max(x)).first()
    schema = "column string, x double, density double"
    if n < limits.kde_min_rows or not std:
        return df.sparkSession.createDataFrame([], schema)
    width = std * n ** (-0.2)
    step = (high - low) / (grid - 1)
    bins = histogram(df, [column], nbins).agg(
        F.array_sort(
            F.collect_list(F.struct(((F.col("low") + F.col("high")) / 2).alias("mid"), "count"))
        ).alias("bins")
    )
    at = F.lit(low) + F.col("i") * F.lit(step)
    points = bins.select("bins", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i"))
    weight = F.aggregate(
        "bins",
        F.lit(0.0),
        lambda total, b: total
        + b["count"] * F.exp(-0.5 * F.pow((F.col("x") - b["mid"]) / F.lit(width), F.lit(2.0))),
    )
    scale = n * width * (2 * 3.141592653589793) ** 0.5
    return points.withColumn("x", at).select(
        F.lit(column).alias("column"), "x", (weight / F.lit(scale)).alias("density")
    )


def correlation_matrix(
    df: DataFrame, columns: Sequence[str] | None = None, limits: Thresholds = DEFAULTS
) -> DataFrame:
    """``(x, y, r)`` for all ordered pairs of numeric columns, pairwise complete."""
    columns = list(columns if columns is not None else numeric_columns(df))
    schema = "x string, y string, r double"
    if len(columns) < limits.heatmap_min_columns:
        return df.sparkSession.createDataFrame([], schema)
    rows = []
    for a, b, _, r in correlations(df, {c: as_double(c) for c in columns}):
        if a == b:
            rows.append((a, b, None if r is None else 1.0))
        else:
            rows += [(a, b, r), (b, a, r)]
    return df.sparkSession.createDataFrame(rows, schema)


def top_bars(
    df: DataFrame, columns: Sequence[str], limits: Thresholds = DEFAULTS
) -> DataFrame:
    """``(column, position, value, count)`` of the most frequent values."""
    return most_frequent(df, columns, limits.bars)


def nullity_matrix(df: DataFrame, order_by: str, buckets: int = 50) -> DataFrame:
    """``(bucket, column, null_share)`` along equal steps of a numeric or time key.

    Any other key that can be ordered is replaced by the row's number in its order. Rows
    without a key are in bucket NULL.
    """
    dtype = types_of(df)[order_by]
    columns = df.columns
    if dtype.typeName().startswith(("timestamp", "date")):
        key = F.unix_micros(ref(order_by).cast("timestamp")).cast("double")
    elif is_numeric(dtype) or isinstance(dtype, T.BooleanType):
        key = as_double(order_by)
    else:
        position = fresh(df, "_position")
        df = row_numbers(df, [order_by], name=position)
        key = F.when(ref(order_by).isNotNull(), ref(position).cast("double"))
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bucket int, column string, null_share double")
    span = (high - low) / buckets or 1.0
    step = F.least(F.floor((key - F.lit(low)) / F.lit(span)), F.lit(buckets - 1)).cast("int")
    bucket = F.when(key.isNotNull(), step)
    shares = df.groupBy(bucket.alias("bucket")).agg(
        *[F.avg(null_mask(df, c).cast("int")).alias(f"s{i}") for i, c in enumerate(columns)]
    )
    pairs = [x for i, c in enumerate(columns) for x in (F.lit(c), F.col(f"s{i}"))]
    return shares.select(
        "bucket", F.stack(F.lit(len(columns)), *pairs).alias("column", "null_share")
    )


def box_stats(
    df: DataFrame, columns: Sequence[str] | None = None, limits: Thresholds = DEFAULTS
) -> DataFrame:
    """Quartiles, whiskers (extreme values inside the fences) and outlier counts."""
    columns = list(columns if columns is not None else numeric_columns(df))
    values = {c: as_double(c) for c in columns}
    limits_of = fences(df, values, limits.iqr_multiplier, with_median=True)
    rows = []
    for group in batches(columns, WIDE_AGG_COLUMNS):
        aggs = []
        for i, c in enumerate(group):
            beyond = outside(values[c], *limits_of[c][:2])
            inner = F.when(~beyond, values[c])
            aggs.append(
                F.struct(F.min(inner), F.max(inner), F.count_if(beyond)).alias(f"b{i}")
            )
        row = df.agg(*aggs).first()
        for i, c in enumerate(group):
            rows.append((c, *limits_of[c][2:], *row[f"b{i}"]))
    return df.sparkSession.createDataFrame(
        rows,
        "column string, q1 double, median double, q3 double, "
        "lower_whisker double, upper_whisker double, outlier_count bigint",
    )


def _settled(df: DataFrame) -> DataFrame:
    """A table of a few rows per column or bin, computed once and kept as literals."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def dashboard(
    df: DataFrame, profile: Profile, order_by: str, limits: Thresholds = DEFAULTS, nbins: int = 20
) -> dict[str, DataFrame]:
    """All tables by chart name; each kind is computed in one go for all columns."""
    charts = {"nullity_matrix": _settled(nullity_matrix(df, order_by))}
    numbers = numeric_columns(df)
    if len(numbers) >= limits.heatmap_min_columns:
        charts["correlation_heatmap"] = correlation_matrix(df, numbers, limits)
    kinds = {c: p.type_category for c, p in profile.columns.items() if c in df.columns}
    drawn = [c for c in numbers if kinds.get(c) in ("numeric", "should_be_numeric")]
    if drawn:
        bins = _settled(histogram(df, drawn, nbins))
        boxes = box_stats(df, drawn, limits)
        for c in drawn:
            charts[f"dist_{c}"] = bins.filter(F.col("column") == c)
            charts[f"box_{c}"] = boxes.filter(F.col("column") == c)
    named = [c for c, kind in kinds.items() if kind == "categorical"]
    if named:
        bars = _settled(top_bars(df, named, limits))
        for c in named:
            charts[f"bar_{c}"] = bars.filter(F.col("column") == c).orderBy("position")
    return charts
