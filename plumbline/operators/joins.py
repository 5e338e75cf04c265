"""Attach a value per key to the rows of a large table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BROADCAST_ROWS
from ..functions.columns import ref

HOT_KEYS = 200


def attach(
    df: DataFrame,
    keys: str | Sequence[str],
    lookup: DataFrame,
    name: str,
    sizes: DataFrame,
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left-join ``lookup(keys, name)``, which has one row per key, to ``df``.

    ``sizes(keys, count)`` holds the row count per key. A lookup of checked size is
    broadcast. A larger one is shuffled, except for its heaviest keys and the missing
    key: those rows stay where they are and meet a broadcast of at most HOT_KEYS rows.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    spark = df.sparkSession
    marks = [f"_key{i}" for i in range(len(keys))]
    right = lookup.select(*[ref(k).alias(m) for k, m in zip(keys, marks)], ref(name).alias(name))
    on = reduce(and_, [ref(k).eqNullSafe(F.col(m)) for k, m in zip(keys, marks)])
    out = [ref(c) for c in [*df.columns, name]]
    found = right.limit(limit + 1).collect()
    if len(found) <= limit:
        # Computed once and of known size.
        return df.join(F.broadcast(spark.createDataFrame(found, right.schema)), on, "left").select(*out)

    heavy = sizes.orderBy(F.desc("count"), *[ref(k) for k in keys]).limit(HOT_KEYS)
    hot = {tuple(r) for r in heavy.select(*[ref(k) for k in keys]).collect()}
    if len(keys) == 1:
        hot.add((None,))
    schema = T.StructType([T.StructField(m, right.schema[m].dataType) for m in marks])
    known = F.broadcast(spark.createDataFrame(list(hot), schema))
    same = reduce(and_, [right[m].eqNullSafe(known[m]) for m in marks])
    cold = df.join(known, on, "left_anti").join(right, on, "left").select(*out)
    few = F.broadcast(right.join(known, same, "left_semi"))
    warm = df.join(known, on, "left_semi").join(few, on, "left").select(*out)
    return cold.unionByName(warm)
