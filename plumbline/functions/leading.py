"""First non-null values of each column in row order.

Rows have no position in Spark, so the order is named by key columns. A prefix of
the table is taken with a bounded top-n. Columns that are too sparse in that prefix are
looked up together in one more pass, however many they are: each task keeps the rows of
the smallest keys for every column, and these bounded states are merged in two levels,
first within groups of tasks. Neither pass sorts the table, and rows with equal
keys stand in any order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import DATETIMES, FLOATS, INTEGERS, STRINGS, is_string, ref, types_of
from .parsing import parse_number, parse_timestamp

MERGE_GROUPS = 256  # groups of tasks whose states are merged before those of all tasks


@dataclass
class Leading:
    """What the first values of one column look like."""

    count: int = 0
    numbers: int = 0
    dates: int = 0
    first_date: datetime | None = None
    last_date: datetime | None = None
    samples: list[str] = field(default_factory=list)


def _summaries(entries: DataFrame, keep: int) -> dict[str, Leading]:
    """Summary per column of ``(column, is_text, order, text)``, at most ``limit`` rows each."""
    text = F.when(F.col("is_text"), F.col("text"))
    parsed = entries.withColumns({"number": parse_number(text), "date": parse_timestamp(text)})
    in_order = F.array_sort(F.collect_list(F.struct("order", "text")))
    grouped = parsed.groupBy("column").agg(
        F.count("*").alias("count"),
        F.count("number").alias("numbers"),
        F.count("date").alias("dates"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.slice(in_order, 1, keep)["text"].alias("samples"),
    )
    return {
        r["column"]: Leading(
            r["count"], r["numbers"], r["dates"], r["first_date"], r["last_date"], list(r["samples"])
        )
        for r in grouped.collect()
    }


def leading_values(
    df: DataFrame,
    order_by: Sequence[str],
    columns: Sequence[str] | None = None,
    limit: int = 100,
    keep: int = 5,
) -> dict[str, Leading]:
    """Summary of the first ``limit`` non-null values (text) or ``keep`` values (others)."""
    columns = list(columns if columns is not None else df.columns)
    if not columns:
        return {}
    types = types_of(df)
    texts = {c: is_string(types[c]) for c in columns}
    order = F.struct(*[ref(k) for k in order_by])

    cells = [F.lit(len(columns))]
    for i, c in enumerate(columns):
        cells += [F.lit(c), F.lit(texts[c]), F.col(f"v{i}")]
    prefix = (
        df.orderBy(*[ref(k) for k in order_by])
        .limit(limit)
        .select(order.alias("order"), *[_present(c, types).alias(f"v{i}") for i, c in enumerate(columns)])
    )
    entries = prefix.select("order", F.stack(*cells).alias("column", "is_text", "text"))
    found = {c: Leading() for c in columns}
    found |= _summaries(entries.filter(F.col("text").isNotNull()), keep)

    need = {c: limit if texts[c] else keep for c in columns}
    sparse = [c for c in columns if found[c].count < need[c]]
    if sparse and len(df.select(order).limit(limit).take(limit)) == limit:
        entries = first_values(df, order_by, {c: need[c] for c in sparse})
        is_text = F.col("column").isin([c for c in sparse if texts[c]])
        found |= _summaries(entries.withColumn("is_text", is_text), keep)
    return found


_PLAIN_KEYS = (*INTEGERS, *FLOATS, *STRINGS, *DATETIMES, T.BooleanType, T.DecimalType, T.BinaryType)


def _key_columns(df: DataFrame, order_by: Sequence[str]) -> dict[str, Column]:
    """Columns that sort, with NULL values last or first, as the keys do: (kind, value) of each.

    The kind is 0 for NULL, 1 for a value and 2 for NaN, whose values are NULL. Nested keys stay as they are.
    """
    types, keys = types_of(df), {}
    for i, name in enumerate(order_by):
        value, dtype = ref(name), types[name]
        if isinstance(dtype, T.BooleanType):
            value = value.cast("int")
        kind = F.when(value.isNull(), 0)
        if isinstance(dtype, FLOATS):
            kind = kind.when(F.isnan(value), 2)
            value = F.when(~F.isnan(value), value)
        keys[f"s{i}"], keys[f"k{i}"] = kind.otherwise(1), value
    return keys


def first_values(df: DataFrame, order_by: Sequence[str], need: dict[str, int]) -> DataFrame:
    """``(column, order, text)``: the first ``need[column]`` present values of each column by the keys.

    One pass over the keys and these columns. Where a key is nested, Spark's own bounded window
    sorts the present values of each task instead.
    """
    types, keys = types_of(df), _key_columns(df, order_by)
    cells = {f"v{i}": _present(c, types) for i, c in enumerate(need)}
    rows = df.select(*[c.alias(n) for n, c in (keys | cells).items()])
    if all(isinstance(types[c], _PLAIN_KEYS) for c in order_by):
        schema = T.StructType([f for f in rows.schema.fields if f.name in keys]).add("place", T.IntegerType()).add("text", T.StringType())
        states = rows.mapInArrow(_bounded_states(list(keys), list(need.values())), schema)
    else:
        pairs = [x for i in range(len(need)) for x in (F.lit(i), F.col(f"v{i}"))]
        states = rows.select(*keys, F.stack(F.lit(len(need)), *pairs).alias("place", "text")).where("text is not null")

    names, sizes = list(need), F.array(*[F.lit(n) for n in need.values()])
    limit = F.element_at(sizes, F.col("place") + 1)
    states = states.withColumn("tasks", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))
    for group in (["place", "tasks"], ["place"]):
        turn = F.row_number().over(W.partitionBy(*group).orderBy(*keys))
        # The constant bound lets Spark cut each task's rows before they are shuffled.
        states = states.withColumn("turn", turn).filter(F.col("turn") <= max(need.values())).filter(F.col("turn") <= limit)
    column = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("place") + 1)
    return states.select(column.alias("column"), F.struct(*keys).alias("order"), "text")


def _bounded_states(keys: list[str], need: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that keeps, for each value column, the rows with the smallest keys."""
    by_key = [(k, "ascending") for k in keys]

    def smallest(parts: list[pa.Table], n: int) -> pa.Table:
        table = pa.concat_tables(parts)
        return table.take(pc.sort_indices(table, sort_keys=by_key)[:n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[pa.Table]] = [[] for _ in need]
        last: list[tuple | None] = [None] * len(need)  # largest key of a column that has enough values
        first_key = lambda t, row: tuple(t.column(k)[row].as_py() for k in keys)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            head = pa.Table.from_batches([batch.select(keys)])
            order = pc.sort_indices(head, sort_keys=by_key).to_numpy()
            for i, n in enumerate(need):
                value = batch.column(f"v{i}")
                if value.null_count == batch.num_rows:
                    continue
                at = order[pc.is_valid(value).to_numpy(zero_copy_only=False)[order]][:n]
                # Keys of one kind are both NULL or both values, so tuples compare.
                if last[i] is not None and first_key(head, at[0]) >= last[i]:
                    continue
                at = pa.array(at)
                kept[i].append(head.take(at).append_column("text", value.take(at)))
                if last[i] is not None or sum(t.num_rows for t in kept[i]) >= n:
                    kept[i] = [smallest(kept[i], n)]
                    last[i] = first_key(kept[i][0], n - 1)
        for i, n in enumerate(need):
            if kept[i]:
                table = smallest(kept[i], n)
                place = pa.array(np.full(table.num_rows, i, np.int32))
                table = table.add_column(len(keys), "place", place).combine_chunks()
                yield from table.to_batches()

    return run


def _present(name: str, types: dict) -> Column:
    value = ref(name)
    if types[name].typeName() in ("float", "double"):
        value = F.when(~F.isnan(value), value)
    return value.cast("string")

