"""Column names and duplicate rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BROADCAST_ROWS
from ..functions.columns import ref, types_of


def standard_names(names: Sequence[str]) -> list[str]:
    """Snake-case names; equal results get a number, empty ones their position."""
    taken: set[str] = set()
    result = []
    for position, name in enumerate(names):
        words = re.sub(r"[\s\-]+", "_", name.strip().lower())
        plain = re.sub(r"\W", "", words) or f"col_{position}"
        unique, copy = plain, 1
        while unique in taken:
            copy += 1
            unique = f"{plain}_{copy}"
        taken.add(unique)
        result.append(unique)
    return result


def standardize_names(df: DataFrame) -> DataFrame:
    return df.toDF(*standard_names(df.columns))


HASH, COPIES = "_row_hash", "_copies"


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of the whole row; equal rows have equal hashes."""
    return F.xxhash64(*[_comparable(ref(c), t, True) for c, t in types_of(df).items()])


def _holds(dtype: T.DataType, kinds: tuple) -> bool:
    """Whether a type or a part of it is of one of the kinds."""
    if isinstance(dtype, T.StructType):
        return any(_holds(f.dataType, kinds) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _holds(dtype.elementType, kinds)
    if isinstance(dtype, T.MapType):
        return isinstance(dtype, kinds) or _holds(dtype.keyType, kinds) or _holds(dtype.valueType, kinds)
    return isinstance(dtype, kinds)


def _comparable(value: Column, dtype: T.DataType, zeros: bool = False) -> Column:
    """A value that can be compared: maps, at any depth, as their entries in order of the keys.

    With ``zeros`` -0.0 becomes 0.0, which it equals.
    """
    kinds = (T.MapType, T.FloatType, T.DoubleType) if zeros else (T.MapType,)
    if not _holds(dtype, kinds):
        return value
    if isinstance(dtype, T.StructType):
        fields = [
            _comparable(value.getField(f.name), f.dataType, zeros).alias(f"f{i}") for i, f in enumerate(dtype.fields)
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: _comparable(x, dtype.elementType, zeros))
    if isinstance(dtype, T.MapType):
        # Keys differ, so values, which may be maps, need no order.
        by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
        entries = F.transform(
            F.map_entries(value),
            lambda e: F.struct(
                _comparable(e["key"], dtype.keyType, zeros).alias("key"),
                _comparable(e["value"], dtype.valueType, zeros).alias("value"),
            ),
        )
        return F.array_sort(entries, by_key)
    return value + F.lit(0.0).cast(dtype)


def _row_keys(df: DataFrame) -> list[Column]:
    """What the rows of ``df`` are compared by."""
    return [_comparable(ref(c), t) for c, t in types_of(df).items()]


def _one_of_each(df: DataFrame) -> DataFrame:
    if not any(_holds(t, (T.MapType,)) for t in types_of(df).values()):
        return df.dropDuplicates()
    keys = [k.alias(f"k{i}") for i, k in enumerate(_row_keys(df))]
    rows = df.groupBy(*keys).agg(F.first(F.struct(*[ref(c) for c in df.columns])).alias("row"))
    return rows.select("row.*")


def repeated_hashes(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame | None:
    """The hashes that occur more than once, or None if there are more than ``limit``.

    Only hashes are shuffled. Rows with another hash have no copy for certain, so whole
    rows need comparing among the repeated hashes alone.
    """
    counts = df.groupBy(row_hash(df).alias(HASH)).agg(F.count("*").alias(COPIES))
    found = counts.filter(F.col(COPIES) > 1).select(HASH).limit(limit + 1).collect()
    if len(found) > limit:
        return None
    return df.sparkSession.createDataFrame(found, f"{HASH} bigint")


def count_duplicates(df: DataFrame, limit: int = BROADCAST_ROWS) -> int:
    """Copies beyond the first of each row; exact."""
    repeated = repeated_hashes(df, limit)
    if repeated is None:
        suspects = df
    elif repeated.isEmpty():
        return 0
    else:
        known = F.broadcast(repeated)
        suspects = df.withColumn(HASH, row_hash(df)).join(known, HASH, "left_semi")
    keys = [k.alias(f"k{i}") for i, k in enumerate(_row_keys(df))]
    groups = suspects.groupBy(*keys).agg(F.count("*").alias(COPIES))
    return groups.agg(F.coalesce(F.sum(F.col(COPIES) - 1), F.lit(0))).first()[0]


def drop_duplicates(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Keep one copy of each row; NULL equals NULL.

    Rows whose hash occurs once stay where they are; only the others are shuffled.
    With more than ``limit`` repeated hashes all rows are.
    """
    if not df.columns:
        return df
    repeated = repeated_hashes(df, limit)
    if repeated is None:
        return _one_of_each(df)
    if repeated.isEmpty():
        return df
    hashed = df.withColumn(HASH, row_hash(df))
    known = F.broadcast(repeated)
    single = hashed.join(known, HASH, "left_anti").drop(HASH)
    copied = hashed.join(known, HASH, "left_semi").drop(HASH)
    return single.unionByName(_one_of_each(copied))
