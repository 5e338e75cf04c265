"""Value frequencies of many columns in one shuffle of pre-counted (column, value) pairs.

Text takes part as a 64-bit hash, with a second hash beside it: the shuffle holds no cell text, and a
hash that stands for two texts shows by two values of the second hash. Then the columns concerned are counted
again by their whole values. The text itself is read in one more scan, for the few hashes whose values
are wanted. A hot value costs one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import INTEGERS, ref, types_of

TIES = 200  # values of one column that are ranked by their text on the driver


@dataclass
class Common:
    """The distinct values of a column: how many, and the most frequent as (value, text, times)."""

    unique: int = 0
    top: list[tuple[object, str, int]] = field(default_factory=list)



def _slots(name: str, dtype: T.DataType) -> tuple[Column, Column, Column]:
    """The value in the slot of its kind, so that equality and order stay typed."""
    value = ref(name)
    whole, real, text = F.lit(None), F.lit(None), F.lit(None)
    if isinstance(dtype, INTEGERS):
        whole = value
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        real = F.when(~F.isnan(value), value)
    elif isinstance(dtype, T.DecimalType):
        # Ordered as a number, kept exact as text.
        real, text = value, value
    else:
        text = value
    return whole.cast("bigint"), real.cast("double"), text.cast("string")


def value_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, whole, real, text, count)`` of every non-null value."""
    types = types_of(df)
    arguments: list[Column] = [F.lit(len(columns))]
    for name in columns:
        arguments += [F.lit(name), *_slots(name, types[name])]
    pairs = df.select(F.stack(*arguments).alias("column", "whole", "real", "text"))
    present = F.coalesce(F.col("whole").isNotNull(), F.lit(False))
    for slot in ("real", "text"):
        present = present | F.col(slot).isNotNull()
    return (
        pairs.filter(present)
        .groupBy("column", "whole", "real", "text")
        .agg(F.count("*").alias("count"))
    )


def value_text() -> Column:
    """The value of a frequency row as text."""
    return F.coalesce(F.col("whole").cast("string"), F.col("text"), F.col("real").cast("string"))


def top_rows(frequencies: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent values per column; equal counts take the smaller value."""
    order = W.partitionBy("column").orderBy(F.desc("count"), "whole", "real", "text")
    return frequencies.withColumn("position", F.row_number().over(order)).filter(
        F.col("position") <= k
    )


def top_values(frequencies: DataFrame, k: int) -> DataFrame:
    """``(column, position, value, count)`` for the ``k`` most frequent values."""
    return top_rows(frequencies, k).select("column", "position", value_text().alias("value"), "count")


def distinct_counts(
    df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False
) -> DataFrame:
    """``(column, unique_count)`` of non-null values, one row per column.

    ``approx`` counts with sketches in one scan and shuffles no values.
    """
    columns = list(columns if columns is not None else df.columns)
    if approx:
        names = {f"u{i}": c for i, c in enumerate(columns)}
        row = df.agg(*[F.approx_count_distinct(ref(c)).alias(u) for u, c in names.items()])
        pairs = [x for u, c in names.items() for x in (F.lit(c), F.col(u))]
        return row.select(F.stack(F.lit(len(columns)), *pairs).alias("column", "unique_count"))
    found = common_values(df, columns)
    return df.sparkSession.createDataFrame([(c, found[c].unique) for c in columns], "column string, unique_count bigint")


def _is_text(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (*INTEGERS, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType, T.DateType))


def _hashed_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(place, whole, real, text, code, count, low, high)``: a value is its slots, or the hash of its text."""
    types = types_of(df)
    none = F.lit(None).cast("bigint")
    cells: list[Column] = [F.lit(len(columns))]
    for i, name in enumerate(columns):
        value, dtype = ref(name), types[name]
        whole, real, text = _slots(name, dtype)
        code = check = none
        if isinstance(dtype, T.BooleanType):
            whole, text = value.cast("int").cast("bigint"), F.lit(None).cast("string")
        elif isinstance(dtype, T.DateType):
            whole, text = F.unix_date(value).cast("bigint"), F.lit(None).cast("string")
        elif _is_text(dtype):
            code, check = _hashes(name)
            text = F.lit(None).cast("string")
        cells += [F.lit(i), whole, real, text, code, check]
    pairs = df.select(F.stack(*cells).alias("place", "whole", "real", "text", "code", "check"))
    # Decimals have a real value beside their text.
    present = F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("code").isNotNull()
    return (
        pairs.filter(present)
        .groupBy("place", "whole", "real", "text", "code")
        .agg(F.count("*").alias("count"), F.min("check").alias("low"), F.max("check").alias("high"))
    )


def _hashes(name: str) -> tuple[Column, Column]:
    text = ref(name).cast("string")
    return tuple(F.when(text.isNotNull(), F.xxhash64(*seed, text)) for seed in ((), (F.lit(1),)))


def common_values(
    df: DataFrame, columns: Sequence[str], k: int = 0, ranked: Sequence[str] | None = None
) -> dict[str, Common]:
    """Exact distinct counts of ``columns`` and the ``k`` most frequent values of those in ``ranked``.

    Of equally frequent values the smaller comes first. At most TIES or ``k`` rows a column reach the driver.
    """
    columns = list(columns)
    if not columns:
        return {}
    types = types_of(df)
    ranked = (columns if ranked is None else list(ranked)) if k else []
    frequencies = _hashed_frequencies(df, columns)
    # One query, and both branches read the same shuffled counts: the sum keeps the counts in the
    # first one, and the condition on the counts keeps the column filter of the second one behind
    # the shuffle.
    slots = ("whole", "real", "text", "code")
    empty = [F.lit(None).cast(frequencies.schema[s].dataType).alias(s) for s in slots]
    sizes = frequencies.groupBy("place").agg(
        F.count("*").alias("count"), F.count_if(F.col("low") < F.col("high")).alias("shared"), F.sum("count").alias("values")
    )
    found = sizes.select(
        "place", F.lit(0).alias("position"), *empty, F.lit(None).cast("string").alias("shown"), "count", "shared", "values"
    )
    if ranked:
        places = {columns.index(c): _is_text(types[c]) for c in ranked}
        texts = [i for i, is_text in places.items() if is_text]
        room = max(TIES, k + 1) if texts else k
        size = F.when(F.col("place").isin(texts), room).otherwise(k) if texts else F.lit(k)
        least = F.when(F.col("place").isin(list(places)), 1).otherwise(2**63 - 1)
        order = W.partitionBy("place").orderBy(F.desc("count"), *slots)
        best = frequencies.filter(F.col("count") >= least).withColumn("position", F.row_number().over(order))
        best = best.filter(F.col("position") <= room).filter(F.col("position") <= size)
        more = [F.lit(None).cast("bigint").alias(n) for n in ("shared", "values")]
        shown = _shown([types[c] for c in columns])
        found = found.unionByName(best.select("place", "position", *slots, shown.alias("shown"), "count", *more))
    result, rows = {c: Common() for c in columns}, {c: [] for c in columns}
    shared = []
    for r in found.orderBy("place", "position").collect():
        name = columns[r["place"]]
        if r["position"]:
            rows[name].append(r)
            continue
        result[name].unique = r["count"]
        if r["shared"]:
            shared.append(name)
    plain = [c for c in ranked if c not in shared and not _is_text(types[c])]
    for name in plain:
        result[name].top = [(*_value(r, types[name]), r["count"]) for r in rows[name]]
    hashed = {c: rows[c] for c in ranked if c not in shared and _is_text(types[c])}
    for name, top in _texts_of(df, hashed, k).items():
        result[name].top = [(text, text, n) for text, n in top]
    if shared:
        result |= _whole_values(df, shared, k, ranked)
    return result


def _shown(kinds: list[T.DataType]) -> Column:
    """The text of a value that is held by its slots."""
    text = value_text()
    for kind, value in (
        (T.BooleanType, (F.col("whole") == 1).cast("string")),
        (T.DateType, F.date_from_unix_date(F.col("whole").cast("int")).cast("string")),
    ):
        places = [i for i, k in enumerate(kinds) if isinstance(k, kind)]
        if places:
            text = F.when(F.col("place").isin(places), value).otherwise(text)
    return text


def _value(row, dtype: T.DataType) -> tuple[object, str]:
    """The value of a row, numbers as such, and as text."""
    if isinstance(dtype, INTEGERS):
        return row["whole"], row["shown"]
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return row["real"], row["shown"]
    return row["shown"], row["shown"]


def _texts_of(df: DataFrame, hashed: dict[str, list], k: int) -> dict[str, list[tuple[str, int]]]:
    """The ``k`` most frequent texts with their counts, from the most frequent hashes of each column."""
    result: dict[str, list[tuple[str, int]]] = {}
    wanted, rest = {}, {}
    for name, rows in hashed.items():
        edge = rows[k - 1]["count"] if len(rows) >= k else 0
        whole = len(rows) < max(TIES, k + 1) or rows[-1]["count"] < edge
        # All values as frequent as the last one are among the rows, or only the more frequent are taken from them.
        wanted[name] = {r["code"]: r["count"] for r in rows if r["count"] > edge or whole and r["count"] == edge}
        if not whole:
            rest[name] = (edge, k - len(wanted[name]))
    cells, names = [], list(hashed)
    for i, name in enumerate(names):
        if wanted[name]:
            cells += [F.lit(i), F.when(_hashes(name)[0].isin(list(wanted[name])), ref(name).cast("string"))]
    texts: dict[str, dict[int, str]] = {c: {} for c in names}
    if cells:
        found = df.select(F.stack(F.lit(len(cells) // 2), *cells).alias("place", "text")).filter(F.col("text").isNotNull())
        for r in found.groupBy("place", F.xxhash64("text").alias("code")).agg(F.min("text").alias("text")).collect():
            texts[names[r["place"]]][r["code"]] = r["text"]
    for name in names:
        # Python orders text by code points, as Spark does.
        known = sorted(((-n, texts[name][code]) for code, n in wanted[name].items()))
        result[name] = [(text, -n) for n, text in known[:k]]
        if name in rest:
            result[name] += _smallest_ties(df, name, list(wanted[name]), *rest[name])
    return result


def _smallest_ties(df: DataFrame, name: str, more: list[int], times: int, size: int) -> list[tuple[str, int]]:
    """The ``size`` smallest texts that occur ``times`` times, where ``more`` are the more frequent ones."""
    text = df.select(ref(name).cast("string").alias("text")).filter(F.col("text").isNotNull())
    if times == 1:
        # All others occur once: the smallest texts, without any shuffle of the column.
        found = text.filter(~F.xxhash64("text").isin(more)) if more else text
    else:
        found = text.groupBy("text").agg(F.count("*").alias("count")).filter(F.col("count") == times).select("text")
    return [(r["text"], times) for r in found.orderBy("text").limit(size).collect()]


def _whole_values(df: DataFrame, columns: list[str], k: int, ranked: Sequence[str]) -> dict[str, Common]:
    """The same by whole values, for columns where two texts share a hash."""
    frequencies = value_frequencies(df, columns)
    sizes = frequencies.groupBy("column").agg(F.count("*").alias("count")).collect()
    result = {r["column"]: Common(r["count"]) for r in sizes}
    names = [c for c in columns if c in ranked]
    if names:
        top = top_values(frequencies.filter(F.col("column").isin(names)), k).orderBy("column", "position")
        for r in top.collect():
            result[r["column"]].top.append((r["value"], r["value"], r["count"]))
    return result


def most_frequent(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """``(column, position, value, count)`` of the ``k`` most frequent values of each column."""
    found = common_values(df, columns, k)
    rows = [(c, i + 1, text, n) for c in columns for i, (_, text, n) in enumerate(found[c].top)]
    return df.sparkSession.createDataFrame(rows, "column string, position int, value string, count bigint")


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value of each column, the smallest on ties; None without values."""
    if not columns:
        return {}
    found = common_values(df, columns, 1)
    return {c: found[c].top[0][0] if found[c].top else None for c in columns}


def bounded_distinct(df: DataFrame, columns: Sequence[str], bound: int) -> dict[str, int | None]:
    """Exact distinct counts up to ``bound``; None for a column with more.

    A sketch first rules out columns far beyond the bound, so only the values of
    low-cardinality columns are ever shuffled.
    """
    if not columns:
        return {}
    estimates = {r["column"]: r["unique_count"] for r in distinct_counts(df, columns, True).collect()}
    near = [c for c in columns if estimates[c] <= 10 * bound + 100]
    exact = {r["column"]: r["unique_count"] for r in distinct_counts(df, near).collect()} if near else {}
    return {c: exact[c] if c in exact and exact[c] <= bound else None for c in columns}
