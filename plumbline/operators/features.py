"""Feature suggestions and transformations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, WIDE_AGG_COLUMNS, Thresholds
from ..functions.columns import (
    as_double,
    batches,
    is_numeric,
    is_string,
    numeric_columns,
    ref,
    require_columns,
    string_columns,
    types_of,
)
from ..functions.counts import bounded_distinct
from ..functions.stats import adjusted_skew
from .joins import attach
from .types import to_categorical

# Names of the suggestions.
LOG = "log1p transform"
BIN = "binning"
STANDARDIZE = "standardize"
ONEHOT = "one-hot encoding"
LABEL = "label encoding or target encoding"
DROP = "consider dropping"


def suggest_features(
    df: DataFrame, target: str | None = None, limits: Thresholds = DEFAULTS, abs_mean: bool = False
) -> DataFrame:
    """``(column, suggestion, reason)`` for every column but the target.

    ``abs_mean`` compares the spread with the mean's size, so that a negative mean no
    longer qualifies by its sign alone.
    """
    numbers = [c for c in numeric_columns(df) if c != target]
    texts = [c for c in string_columns(df) if c != target]
    stats = {}
    for group in batches(numbers, WIDE_AGG_COLUMNS):
        aggs = []
        for i, c in enumerate(group):
            x = as_double(c)
            aggs += [
                adjusted_skew(x).alias(f"skew{i}"),
                F.min(x).alias(f"min{i}"),
                F.max(x).alias(f"max{i}"),
                F.avg(x).alias(f"mean{i}"),
                F.stddev_samp(x).alias(f"std{i}"),
            ]
        row = df.agg(*aggs).first()
        for i, c in enumerate(group):
            stats[c] = {k: row[f"{k}{i}"] for k in ("skew", "min", "max", "mean", "std")}
    wide = [c for c in numbers if _range(stats[c]) > limits.bin_min_range]
    few = bounded_distinct(df, wide, limits.bin_min_distinct)
    levels = bounded_distinct(df, texts, limits.label_max)

    rows = []
    for c in df.columns:
        if c in stats:
            s = stats[c]
            if s["skew"] is not None and abs(s["skew"]) > limits.skew_moderate and s["min"] >= 0:
                rows.append((c, LOG, f"skewness {s['skew']:.2f}, no negative values"))
            if c in few and few[c] is None:
                rows.append((c, BIN, "wide range with many values"))
            mean = s["mean"] if s["mean"] is None or not abs_mean else abs(s["mean"])
            if mean and s["std"] is not None and s["std"] > limits.standardize_factor * mean:
                rows.append((c, STANDARDIZE, "spread is large against the mean"))
        elif c in levels:
            n = levels[c]
            if n is None:
                rows.append((c, DROP, f"more than {limits.label_max} values"))
            else:
                kind = ONEHOT if n <= limits.onehot_max else LABEL
                rows.append((c, kind, f"{n} values"))
    return df.sparkSession.createDataFrame(rows, "column string, suggestion string, reason string")


def _range(s: dict) -> float:
    return s["max"] - s["min"] if s["min"] is not None else 0.0


def add_log1p(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(f"{column}_log", F.log1p(as_double(column)))


def add_bins(df: DataFrame, column: str, bins: int = DEFAULTS.bins) -> DataFrame:
    """Equal-width bins, closed on the right; the minimum falls in bin 0."""
    x = as_double(column)
    low, high = df.agg(F.min(x), F.max(x)).first()
    if low is None or low == high:
        inside = F.lit(bins // 2)
    else:
        step = F.ceil((x - F.lit(low)) / F.lit((high - low) / bins)) - 1
        inside = F.least(F.greatest(step, F.lit(0)), F.lit(bins - 1))
    return df.withColumn(f"{column}_bin", F.when(x.isNotNull(), inside).cast("int"))


def add_standardized(df: DataFrame, column: str) -> DataFrame:
    """Distance to the mean in sample standard deviations."""
    x = as_double(column)
    mean, std = df.agg(F.avg(x), F.stddev_samp(x)).first()
    scaled = (x - F.lit(mean)) / F.lit(std) if std else F.lit(None).cast("double")
    return df.withColumn(f"{column}_scaled", scaled)


def add_onehot(df: DataFrame, column: str, max_levels: int = DEFAULTS.label_max) -> DataFrame:
    """One 0/1 column per sorted value but the first; the column itself goes."""
    require_columns(df, [column])
    found = (
        df.filter(ref(column).isNotNull()).select(ref(column).alias("v")).distinct().limit(max_levels + 1)
    ).collect()
    if len(found) > max_levels:
        raise ValueError(f"{column} has more than {max_levels} values")
    levels = sorted(r["v"] for r in found)
    flags = [
        F.coalesce(ref(column) == F.lit(v), F.lit(False)).cast("int").alias(f"{column}_{v}")
        for v in levels[1:]
    ]
    return df.select(*[ref(c) for c in df.columns if c != column], *flags)


def add_label(df: DataFrame, column: str) -> DataFrame:
    """Position of each value among the sorted values."""
    return to_categorical(df, column, f"{column}_enc")


def add_target_mean(df: DataFrame, column: str, target: str) -> DataFrame:
    """Mean target of the row's value: aggregated once and attached, no window."""
    means = df.groupBy(ref(column)).agg(
        F.avg(as_double(target)).alias(f"{column}_target_mean"), F.count("*").alias("count")
    )
    lookup = means.filter(ref(column).isNotNull())
    return attach(df, column, lookup, f"{column}_target_mean", means.select(ref(column), "count"))


def apply_suggestions(
    df: DataFrame, suggestions: DataFrame, skip: Sequence[str] = ()
) -> DataFrame:
    """Carry out suggestions, one per row; labels are used where label or target is offered."""
    steps = {LOG: add_log1p, BIN: add_bins, STANDARDIZE: add_standardized, LABEL: add_label}
    steps |= {ONEHOT: add_onehot, DROP: lambda d, c: d.drop(ref(c))}
    types = types_of(df)
    for r in suggestions.collect():  # at most three per column
        c = r["column"]
        if c in types and c not in skip and (is_numeric(types[c]) or is_string(types[c])):
            df = steps[r["suggestion"]](df, c)
    return df
