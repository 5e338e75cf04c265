"""Profiles that are kept per chunk and merged later.

A chunk's state is one row per column: counts, centred moments, extremes and two
sketches. States of any number of chunks combine into states, level by level if there
are many, so new data never needs a second look at old data. Counts, moments and extremes merge exactly; medians,
distinct and outlier counts come from sketches and are approximate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULTS, Thresholds
from ..functions.columns import as_double, is_numeric, is_string, ref, types_of
from ..functions.counts import top_values, value_frequencies
from ..functions.stats import skew_label
from .profile import null_mask

GRID = 1000  # steps at which a merged sketch is read
TAILS = [10 ** (-e / 20) for e in range(200, 60, -1)]  # finer steps at either end, for outliers
RANKS = [0.0, *TAILS, *(i / GRID for i in range(1, GRID)), *(1 - t for t in reversed(TAILS)), 1.0]
SKETCH_SIZE = 4096  # ranks, and so outlier counts, are off by some 0.2 % of the rows at most


def profile_states(
    df: DataFrame, columns: Sequence[str] | None = None, chunk: Column | None = None
) -> DataFrame:
    """State rows ``(chunk, column, type_category, n, nulls, mean, m2, m3, min, max, ...)``."""
    types = types_of(df)
    columns = list(columns if columns is not None else df.columns)
    aggs = []
    for i, c in enumerate(columns):
        numeric = is_numeric(types[c])
        x = as_double(c) if numeric else F.lit(None).cast("double")
        n, m2 = F.count(x), F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0))
        skew = F.coalesce(F.skewness(x), F.lit(0.0))
        m3 = F.when(n > 0, skew * n * F.pow(m2 / n, F.lit(1.5))).otherwise(F.lit(0.0))
        values = F.count_if(~null_mask(df, c))
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(_category(types[c])).alias("type_category"),
                values.alias("n"),
                (F.count("*") - values).alias("nulls"),
                F.avg(x).alias("mean"),
                m2.alias("m2"),
                m3.alias("m3"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
                F.kll_sketch_agg_double(x, F.lit(SKETCH_SIZE)).alias("quantiles"),
                F.hll_sketch_agg(ref(c).cast("string")).alias("distinct"),
            ).alias(f"s{i}")
        )
    key = F.lit("all") if chunk is None else chunk.cast("string")
    grouped = df.groupBy(key.alias("chunk")).agg(*aggs)
    states = F.explode(F.array(*[F.col(f"s{i}") for i in range(len(columns))])).alias("s")
    return grouped.select("chunk", states).select("chunk", "s.*")


def _category(dtype: T.DataType) -> str:
    """No inference here: text is categorical, and what is neither text nor number is other."""
    if is_numeric(dtype):
        return "numeric"
    return "categorical" if is_string(dtype) or isinstance(dtype, T.BooleanType) else "other"


def combine_states(states: DataFrame, chunk: Column | None = None) -> DataFrame:
    """States of several chunks as one state per column and new ``chunk`` (default: all in one).

    The result is again a table of states, so chunks can be combined level by level. ``states`` is
    read twice and should be a stored table.
    """
    key = F.lit("all") if chunk is None else chunk.cast("string")
    keyed, by = states.withColumn("chunk", key), ["chunk", "column"]
    weighted = F.sum(F.col("mean") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))
    pooled = keyed.groupBy(*by).agg(weighted.alias("_mean"))
    # Without a chunk there is one row per column of the profiled table.
    about = keyed.join(F.broadcast(pooled) if chunk is None else pooled, by)
    gap, n = F.col("mean") - F.col("_mean"), F.col("n")
    merged = about.groupBy(*by, "type_category").agg(
        F.sum("n").alias("n"),
        F.sum("nulls").alias("nulls"),
        F.first("_mean").alias("mean"),
        F.sum(F.col("m2") + F.coalesce(n * gap * gap, F.lit(0.0))).alias("m2"),
        F.sum(F.col("m3") + F.coalesce(3 * gap * F.col("m2") + n * gap * gap * gap, F.lit(0.0))).alias("m3"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.hll_union_agg("distinct").alias("distinct"),
    )
    return merged.select("chunk", "column", "type_category", *[c for c in merged.columns if c not in (*by, "type_category")])


def merge_states(states: DataFrame, limits: Thresholds = DEFAULTS, digits: int = 4) -> DataFrame:
    """One profile row per column from the states of all chunks."""
    merged = combine_states(states).withColumnsRenamed({"nulls": "null_count"})
    merged = merged.withColumn("approx_unique_count", F.hll_sketch_estimate("distinct"))
    numeric = F.col("type_category") == "numeric"
    present = numeric & (F.col("n") > 0)
    spread = F.col("m2") / F.nullif(F.col("n"), F.lit(0))
    g1 = F.try_divide(F.col("m3") / F.col("n"), F.pow(spread, F.lit(1.5)))
    size = F.col("n").cast("double")
    skew = F.when(
        present & (F.col("n") >= 3),
        F.coalesce(g1 * F.sqrt(size * (size - 1)) / (size - 2), F.lit(0.0)),
    )
    grid = F.lit(RANKS)
    quantiles = F.when(present, F.kll_sketch_get_quantile_double("quantiles", grid))
    stats = merged.withColumns({"_q": quantiles, "skewness": skew})
    q1, q3 = F.col("_q")[RANKS.index(0.25)], F.col("_q")[RANKS.index(0.75)]
    low, high = q1 - limits.iqr_multiplier * (q3 - q1), q3 + limits.iqr_multiplier * (q3 - q1)
    # The extremes are exact: a side without values beyond its fence adds nothing, any other at least one.
    # Ranks are symmetric, so the share above a fence is read as the share below one.
    share = lambda steps: F.when(steps > 0, F.element_at(grid, F.greatest(steps, F.lit(1)))).otherwise(0.0)
    below, above = F.size(F.filter("_q", lambda v: v < low)), F.size(F.filter("_q", lambda v: v > high))
    under = F.when(F.col("min") < low, F.greatest(size * share(below), F.lit(1.0))).otherwise(0.0)
    over = F.when(F.col("max") > high, F.greatest(size * share(above), F.lit(1.0))).otherwise(0.0)
    outliers = F.when(present, F.round(under + over).cast("bigint"))
    total = F.col("n") + F.col("null_count")
    return stats.select(
        "column",
        "type_category",
        total.alias("rows"),
        "null_count",
        F.round(F.try_divide(F.col("null_count") * 100.0, total), 6).alias("null_percent"),
        F.round("mean", digits).alias("mean"),
        F.round(F.when(present, F.sqrt(spread)), digits).alias("std"),
        F.round("min", digits).alias("min"),
        F.round("max", digits).alias("max"),
        F.round("skewness", digits).alias("skewness"),
        F.when(present, skew_label(F.round("skewness", digits), limits)).alias("skew_label"),
        F.col("_q")[RANKS.index(0.5)].alias("approx_median"),
        "approx_unique_count",
        outliers.alias("approx_outlier_count"),
    )


def frequency_states(df: DataFrame, columns: Sequence[str], chunk: Column | None = None) -> DataFrame:
    """Value counts ``(column, whole, real, text, count)`` of one chunk."""
    return value_frequencies(df if chunk is None else df.filter(chunk), columns)


def combine_frequencies(states: DataFrame) -> DataFrame:
    """Value counts of several chunks as value counts of all of them."""
    return states.groupBy("column", "whole", "real", "text").agg(F.sum("count").alias("count"))


def merge_frequencies(states: DataFrame, k: int = DEFAULTS.top_values) -> DataFrame:
    """Top values from the value counts of all chunks."""
    return top_values(combine_frequencies(states), k)
