"""Operators over the row order of a table, without one task that sees all rows.

The order (and the optional grouping in front of it) is cut into ranges at sampled
boundary keys. Each range is one window partition; what a range needs from the ranges
before it is a carry of one row per range, joined back as a table that never exceeds
the number of ranges. A hot group is therefore spread over many ranges, and groups
are never collected. ``order_by`` must name a unique order within a group.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import MAX_RANGES, ROWS_PER_RANGE
from ..functions.columns import fresh, ref, types_of
from .joins import attach

SAMPLES_PER_RANGE = 20


def _key(names: Sequence[str]) -> Column:
    return F.struct(*[ref(n).alias(f"k{i}") for i, n in enumerate(names)])


def _boundaries(df: DataFrame, keys: Sequence[str], ranges: int, rows: int) -> list[tuple]:
    """Boundary keys from a bounded sample; they only balance ranges, any choice is correct."""
    share = min(1.0, SAMPLES_PER_RANGE * ranges / rows)
    sample = (
        df.select(*[ref(k) for k in keys])
        .sample(share, seed=11)
        .orderBy(*[ref(k) for k in keys])
        .collect()
    )
    picks = sorted({len(sample) * i // ranges for i in range(1, ranges)} - {0})
    return [tuple(sample[p]) for p in picks if p < len(sample)]


def _edge_array(bounds: list[tuple], types: Sequence[T.DataType]) -> Column:
    """All boundaries as one constant array; one literal keeps the plan small."""

    def plain(value):
        return value.isoformat() if hasattr(value, "isoformat") else str(value)

    entry = ", ".join(f"k{i}: {t.simpleString()}" for i, t in enumerate(types))
    rows = [{f"k{i}": v for i, v in enumerate(b) if v is not None} for b in bounds]
    text = json.dumps(rows, default=plain, ensure_ascii=False)
    return F.from_json(F.lit(text), f"array<struct<{entry}>>", {"timeZone": "UTC"})


def _locate(key: Column, edges: Column, count: int) -> Column:
    """Number of boundaries at or below the key, by halving: some log2(count) comparisons a row."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(count.bit_length()))])

    def halved(k: Column) -> Column:
        # Beyond the last boundary there is no entry, and no step is taken.
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) <= k, at + step).otherwise(at))

    # The key is built once a row; the result is never NULL, so no filter repeats the search.
    return F.coalesce(F.get(F.transform(F.array(key), halved), F.lit(0)), F.lit(0))


class Ranges:
    """A table cut into ranges of (group, order)."""

    def __init__(
        self,
        df: DataFrame,
        order_by: Sequence[str],
        partition_by: Sequence[str] = (),
        rows_per_range: int = ROWS_PER_RANGE,
        rows: int | None = None,
    ):
        self.order_by, self.partition_by = list(order_by), list(partition_by)
        keys = self.partition_by + self.order_by
        types = types_of(df)
        rows = df.count() if rows is None else rows
        wanted = min(MAX_RANGES, math.ceil(rows / rows_per_range)) if rows else 1
        self.bucket = fresh(df, "_range")
        self.bounds = _boundaries(df, keys, wanted, rows) if wanted > 1 else []
        self.single = not self.bounds
        odd = [k for k in keys if not isinstance(types[k], T.AtomicType) or isinstance(types[k], T.BinaryType)]
        if odd:
            raise TypeError(f"rows cannot be ordered by {', '.join(odd)}")
        located, self.edges = F.lit(0), None
        if self.bounds:
            self.edges = _edge_array(self.bounds, [types[k] for k in keys])
            located = _locate(_key(keys), self.edges, len(self.bounds))
        self.df = df.withColumn(self.bucket, located)

    def window(self, *extra: str) -> W:
        parts = [ref(c) for c in (self.bucket, *self.partition_by, *extra)]
        return W.partitionBy(*parts).orderBy(*[ref(k) for k in self.order_by])

    def order(self) -> Column:
        return _key(self.order_by)

    def _edges(self) -> DataFrame:
        """``(_range, _group)``: each range but the first, with the group it begins in.

        Only that group can have rows in the ranges before. At most MAX_RANGES rows.
        """
        edges = self.df.sparkSession.range(1).select(F.posexplode(self.edges).alias("_at", "_key"))
        begins = [F.col(f"_key.k{i}").alias(f"k{i}") for i in range(len(self.partition_by))]
        group = F.struct(*begins) if begins else F.struct(F.lit(0).alias("k0"))
        return edges.select((F.col("_at") + 1).alias("_edge"), group.alias("_begins"))

    def with_carry(self, df: DataFrame, aggs: dict[str, Column], combine: dict[str, object]) -> DataFrame:
        """Add columns that summarise the same group's rows in all earlier ranges.

        ``aggs`` summarise, per range, the rows of the group the next range begins in;
        ``combine`` folds those summaries over the earlier ranges. Rows of other groups
        get NULL, as nothing of theirs lies before their range.
        """
        if self.single:
            types = df.agg(*[a.alias(n) for n, a in aggs.items()]).schema
            return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in types.fields})
        edges = self._edges()
        group = _key(self.partition_by) if self.partition_by else F.struct(F.lit(0).alias("k0"))
        # Broadcasts here have at most MAX_RANGES rows.
        ends = df.join(F.broadcast(edges), ref(self.bucket) + 1 == F.col("_edge"))
        summary = (
            ends.filter(group.eqNullSafe(F.col("_begins")))
            .groupBy("_edge")
            .agg(*[a.alias(n) for n, a in aggs.items()])
        )
        upto = W.partitionBy("_begins").orderBy("_edge").rowsBetween(W.unboundedPreceding, W.currentRow)
        carry = edges.join(summary, "_edge", "left").select(
            "_edge", "_begins", *[combine[n](F.col(n)).over(upto).alias(n) for n in aggs]
        )
        joined = df.join(F.broadcast(carry), ref(self.bucket) == F.col("_edge"), "left")
        same = group.eqNullSafe(F.col("_begins"))
        return joined.withColumns({n: F.when(same, F.col(n)) for n in aggs}).drop("_edge", "_begins")


def forward_fill(
    df: DataFrame,
    columns: str | Sequence[str],
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Replace NULLs by the last value before them; leading NULLs stay."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    ranges = Ranges(df, order_by, partition_by, **options)
    upto = ranges.window().rowsBetween(W.unboundedPreceding, W.currentRow)
    aggs, combine = {}, {}
    for i, c in enumerate(columns):
        present = F.when(ref(c).isNotNull(), ranges.order())
        aggs[f"_carry{i}"] = F.max_by(ref(c), present)
        combine[f"_carry{i}"] = lambda v: F.last(v, ignorenulls=True)
    carried = ranges.with_carry(ranges.df, aggs, combine)
    filled = {
        c: F.coalesce(F.last(ref(c), ignorenulls=True).over(upto), F.col(f"_carry{i}"))
        for i, c in enumerate(columns)
    }
    return carried.withColumns(filled).select(*[ref(c) for c in df.columns])


def running_sum(
    df: DataFrame,
    column: str,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    name: str | None = None,
    **options,
) -> DataFrame:
    """Cumulative sum in row order; NULLs add nothing and stay NULL."""
    ranges = Ranges(df, order_by, partition_by, **options)
    upto = ranges.window().rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = ranges.with_carry(ranges.df, {"_carry": F.sum(ref(column))}, {"_carry": F.sum})
    total = F.sum(ref(column)).over(upto) + F.coalesce(F.col("_carry"), F.lit(0))
    name = name or f"{column}_cumsum"
    return carried.withColumn(name, F.when(ref(column).isNotNull(), total)).select(
        *[ref(c) for c in dict.fromkeys([*df.columns, name])]
    )


def running_mean(
    df: DataFrame,
    column: str,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    name: str | None = None,
    **options,
) -> DataFrame:
    """Expanding mean of the values so far."""
    ranges = Ranges(df, order_by, partition_by, **options)
    upto = ranges.window().rowsBetween(W.unboundedPreceding, W.currentRow)
    value = ref(column).cast("double")
    carried = ranges.with_carry(
        ranges.df,
        {"_carry": F.sum(value), "_carried": F.count(value)},
        {"_carry": F.sum, "_carried": F.sum},
    )
    total = F.coalesce(F.sum(value).over(upto), F.lit(0.0)) + F.coalesce(F.col("_carry"), F.lit(0.0))
    count = F.count(value).over(upto) + F.coalesce(F.col("_carried"), F.lit(0))
    name = name or f"{column}_expanding_mean"
    return carried.withColumn(name, F.try_divide(total, count.cast("double"))).select(
        *[ref(c) for c in dict.fromkeys([*df.columns, name])]
    )


def _numbered(ranges: Ranges, name: str) -> DataFrame:
    """Row number within each group, the range column kept."""
    carried = ranges.with_carry(ranges.df, {"_carry": F.count("*")}, {"_carry": F.sum})
    number = F.row_number().over(ranges.window()) + F.coalesce(F.col("_carry"), F.lit(0))
    return carried.withColumn(name, number.cast("bigint")).drop("_carry")


def row_numbers(
    df: DataFrame,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    name: str = "row_number",
    **options,
) -> DataFrame:
    """One-based position of each row in its group."""
    ranges = Ranges(df, order_by, partition_by, **options)
    return _numbered(ranges, name).select(*[ref(c) for c in [*df.columns, name]])


def rank_values(
    df: DataFrame,
    column: str,
    partition_by: Sequence[str] = (),
    name: str = "rank",
    method: str = "min",
    **options,
) -> DataFrame:
    """Rank of each row's value, ascending; ties share a rank (min, dense or average).

    Equal values are counted before anything is ordered, so a hot value is one row of
    the ranked table. The ranks come back by a lookup of the value.
    """
    group = list(partition_by)
    counts = df.filter(ref(column).isNotNull()).groupBy(*[ref(c) for c in [*group, column]]).agg(
        F.count("*").alias("_ties")
    )
    before = running_sum(counts, "_ties", [column], group, "_upto", **options)
    if method == "dense":
        ranked = row_numbers(counts, [column], group, name, **options)
    elif method == "average":
        ranked = before.withColumn(name, F.col("_upto") - (F.col("_ties") - 1) / 2.0)
    else:
        ranked = before.withColumn(name, F.col("_upto") - F.col("_ties") + 1)
    some = df.filter(ref(column).isNotNull())
    sizes = counts.withColumnRenamed("_ties", "count")
    with_rank = attach(some, [*group, column], ranked, name, sizes)
    dtype = with_rank.schema[name].dataType
    none = df.filter(ref(column).isNull()).withColumn(name, F.lit(None).cast(dtype))
    return with_rank.unionByName(none)


def neighbours(
    df: DataFrame,
    order_by: Sequence[str],
    expressions: dict[str, object],
    reach: int,
    partition_by: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
    ahead: int = 0,
    **options,
) -> DataFrame:
    """Window expressions that look at most ``reach`` rows back and ``ahead`` rows on.

    Rows are numbered once and cut into equal blocks; each block also receives the last
    ``reach`` rows of the block before it and the first ``ahead`` rows of the block behind
    it, so every window is complete in its block.
    ``expressions`` maps a name to a function of the ordered window.
    """
    if min(reach, ahead) < 0:
        raise ValueError("reach and ahead count rows and are not negative")
    ranges = Ranges(df, order_by, partition_by, rows_per_range, **options)
    if ranges.single:
        added = {n: e(ranges.window()) for n, e in expressions.items()}
        return ranges.df.withColumns(added).select(*[ref(c) for c in [*df.columns, *added]])
    size = max(rows_per_range, reach, ahead)
    at = F.col("_at") - 1
    block = F.floor(at / size)
    numbered = _numbered(ranges, "_at").withColumn(
        "_blocks",
        F.array_compact(
            F.array(
                block,
                F.when(at % size >= size - reach, block + 1),
                F.when((at % size < ahead) & (block > 0), block - 1),
            )
        ),
    )
    spread = numbered.withColumn("_block", F.explode("_blocks"))
    window = W.partitionBy(*[ref(c) for c in ["_block", *partition_by]]).orderBy("_at")
    added = {n: e(window) for n, e in expressions.items()}
    return (
        spread.withColumns(added)
        .filter(F.col("_block") == F.floor((F.col("_at") - 1) / size))
        .select(*[ref(c) for c in [*df.columns, *added]])
    )


def shift(
    df: DataFrame,
    column: str,
    order_by: Sequence[str],
    periods: int = 1,
    partition_by: Sequence[str] = (),
    name: str | None = None,
    **options,
) -> DataFrame:
    """The value ``periods`` rows earlier, or later if negative."""
    name = name or f"{column}_shift"
    return neighbours(
        df,
        order_by,
        {name: lambda w: F.lag(ref(column), periods).over(w)},
        max(periods, 0),
        partition_by,
        ahead=max(-periods, 0),
        **options,
    )


def changes(
    df: DataFrame,
    column: str,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Difference and relative change to the row before."""
    value = ref(column).cast("double")
    return neighbours(
        df,
        order_by,
        {
            f"{column}_diff": lambda w: value - F.lag(value).over(w),
            f"{column}_pct_change": lambda w: F.try_divide(value, F.lag(value).over(w)) - 1,
        },
        1,
        partition_by,
        **options,
    )


def rolling_mean(
    df: DataFrame,
    column: str,
    order_by: Sequence[str],
    size: int,
    partition_by: Sequence[str] = (),
    name: str | None = None,
    **options,
) -> DataFrame:
    """Mean of the last ``size`` rows; NULL until that many values are there."""
    name = name or f"{column}_rolling"
    value = ref(column).cast("double")

    def mean(window):
        frame = window.rowsBetween(-(size - 1), W.currentRow)
        return F.when(F.count(value).over(frame) == size, F.avg(value).over(frame))

    return neighbours(df, order_by, {name: mean}, size - 1, partition_by, **options)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: Sequence[str] = (),
    values: Sequence[str] = (),
    tiebreak: str | None = None,
    **options,
) -> DataFrame:
    """For each left row, ``values`` of the last right row of the same ``by`` at or before ``on``.

    Both sides are laid in one order, right rows first on equal keys, and the right
    side's values are filled forward; no pairs are formed. ``tiebreak`` names a unique
    left column.
    """
    by, values = list(by), list(values)
    extra = [c for c in left.columns if c not in (*by, on)]
    left_types = types_of(left)
    right_types = types_of(right)
    carried = F.struct(*[ref(v).alias(f"v{i}") for i, v in enumerate(values)])
    # Right rows with equal keys are one candidate each; the largest value wins.
    candidates = right.groupBy(*[ref(c) for c in [*by, on]]).agg(F.max(carried).alias("_carried"))
    empty = candidates.schema["_carried"].dataType
    rows = left.withColumns({"_side": F.lit(1), "_carried": F.lit(None).cast(empty)}).unionByName(
        candidates.withColumns({c: F.lit(None).cast(left_types[c]) for c in extra}).withColumn(
            "_side", F.lit(0)
        )
    )
    order = [on, "_side"] + ([tiebreak] if tiebreak else [])
    filled = forward_fill(rows, "_carried", order, by, **options)
    return filled.filter(F.col("_side") == 1).select(
        *[ref(c) for c in left.columns],
        *[F.col(f"_carried.v{i}").cast(right_types[v]).alias(v) for i, v in enumerate(values)],
    )
