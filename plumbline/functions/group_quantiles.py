"""Exact, interpolated quantiles of every group at once.

A group may hold most of a table, so its values are never gathered. For the groups of more than
a fixed number of values, one mergeable sketch per group proposes a value bracket around each wanted rank,
and one counting pass proves for all of them that the bracket holds the rank. Brackets that still hold
many values are narrowed again. What is left inside is counted by value, so a hot value is
one row, and the rank is read off running counts over a bounded number of rows. Small
groups are counted by value as they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import BROADCAST_ROWS
from ..session import materialize
from .columns import ref

GROUP_ROWS = 10_000  # values of a group that are counted without a bracket
STEPS = 256  # values that are asked of a sketch, evenly spread over the ranks
SKETCH = 1024
MARGIN = 4 * 2.296 / SKETCH**0.9021  # four times the sketch's rank error
INF = float("inf")


def _with_state(work: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """The values with the row of their group; groups without one are left out."""
    right = state.toDF(*[f"_{c}" if c in keys else c for c in state.columns])
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    if state.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        right = F.broadcast(right)
    return work.join(right, on).drop(*[f"_{k}" for k in keys])


def _wide(i: int, limit: int) -> Column:
    return F.col(f"between{i}") > limit


def _narrowed(work: DataFrame, state: DataFrame, keys: list[str], n: int, limit: int) -> DataFrame:
    """One round for the groups with a bracket that is too wide."""
    x = F.col("x")
    inside = _with_state(work, state, keys)
    sketches = inside.groupBy(*keys).agg(
        *[
            F.kll_sketch_agg_double(
                F.when(_wide(i, limit) & x.between(F.col(f"low{i}"), F.col(f"high{i}")), x), F.lit(SKETCH)
            ).alias(f"k{i}")
            for i in range(n)
        ]
    )
    asked = _with_state(sketches, state, keys)
    grid = F.array(*[F.lit(s / STEPS) for s in range(STEPS + 1)])
    columns = {}
    for i in range(n):
        slack = F.lit(MARGIN) * F.pow(F.lit(2.0), F.col(f"tries{i}"))
        size = F.col(f"inside{i}")
        down = (F.floor(F.col(f"at{i}")) - F.col(f"below{i}")) / size - slack
        up = (F.ceil(F.col(f"at{i}")) + 1 - F.col(f"below{i}")) / size + slack
        values = F.when(_wide(i, limit), F.kll_sketch_get_quantile_double(f"k{i}", grid))
        columns[f"a{i}"] = values[F.greatest(F.floor(down * STEPS), F.lit(0)).cast("int")]
        columns[f"b{i}"] = values[F.least(F.ceil(up * STEPS), F.lit(STEPS)).cast("int")]
    proposed = materialize(asked.withColumns(columns).drop(*[f"k{i}" for i in range(n)]))
    checked = _with_state(work, proposed.select(*keys, *columns), keys).groupBy(*keys).agg(
        *[
            part.alias(f"{name}{i}")
            for i in range(n)
            for name, part in (
                ("under", F.count_if(x < F.col(f"a{i}"))),
                ("upto", F.count_if(x <= F.col(f"b{i}"))),
                ("strict", F.count_if((x > F.col(f"a{i}")) & (x < F.col(f"b{i}")))),
            )
        ]
    )
    both = _with_state(proposed, checked, keys)
    new = {}
    for i in range(n):
        fits = (F.col(f"under{i}") <= F.floor(F.col(f"at{i}"))) & (F.ceil(F.col(f"at{i}")) < F.col(f"upto{i}"))
        taken = F.coalesce(_wide(i, limit) & fits, F.lit(False))
        missed = F.coalesce(_wide(i, limit) & ~fits, F.lit(False))
        for name, value in (
            ("low", F.col(f"a{i}")), ("high", F.col(f"b{i}")), ("below", F.col(f"under{i}")),
            ("inside", F.col(f"upto{i}") - F.col(f"under{i}")), ("between", F.col(f"strict{i}")), ("tries", F.lit(0)),
        ):
            new[f"{name}{i}"] = F.when(taken, value).otherwise(F.col(f"{name}{i}"))
        new[f"tries{i}"] = F.when(missed, F.col(f"tries{i}") + 1).otherwise(new[f"tries{i}"])
    return materialize(both.select(*keys, "n", *[f"at{i}" for i in range(n)], *[c.alias(k) for k, c in new.items()]))


def group_quantiles(
    df: DataFrame, by: Sequence[str], value: Column, probs: Sequence[float], limit: int = GROUP_ROWS
) -> DataFrame:
    """The columns of ``by`` and q0, q1, ... for each probability; NULLs do not count.

    Groups whose values are all NULL have NULL quantiles. Without ``by`` the table is one group.
    """
    n, keys = len(probs), [f"g{i}" for i in range(max(len(by), 1))]
    named = [ref(c) for c in by] or [F.lit(0)]
    work = df.select(*[c.alias(k) for c, k in zip(named, keys)], value.cast("double").alias("x"))
    sizes = materialize(work.groupBy(*keys).agg(F.count("x").alias("n")))
    work = work.filter(F.col("x").isNotNull())
    start = {}
    for i, p in enumerate(probs):
        start |= {f"at{i}": (F.col("n") - 1) * F.lit(float(p)), f"low{i}": F.lit(-INF), f"high{i}": F.lit(INF)}
        start |= {f"below{i}": F.lit(0).cast("bigint"), f"inside{i}": F.col("n"), f"between{i}": F.col("n"), f"tries{i}": F.lit(0)}
    state = sizes.withColumns(start)
    some = lambda c: reduce(or_, [c(i) for i in range(n)])
    done, large = [], state.filter(F.col("n") > limit)
    while not large.isEmpty():
        if not large.filter(some(lambda i: F.col(f"tries{i}") > 20)).isEmpty():
            raise RuntimeError("no bracket found for a quantile")
        moved = _narrowed(work, large, keys, n, limit)
        done.append(moved.filter(~some(lambda i: _wide(i, limit))))
        large = moved.filter(some(lambda i: _wide(i, limit)))

    # Values by place: -1 holds all values of a small group, the others those of one bracket.
    small = state.filter(F.col("n") <= limit)
    whole = _with_state(work, small.select(*keys), keys).select(*keys, F.lit(-1).alias("place"), "x")
    parts = [whole]
    known = small.select(*keys, *[f"at{i}" for i in range(n)], *[f"below{i}" for i in range(n)])
    if done:
        solved = reduce(DataFrame.unionByName, done)
        held = _with_state(work, solved.select(*keys, *[f"{e}{i}" for i in range(n) for e in ("low", "high")]), keys)
        places = [F.when(F.col("x").between(F.col(f"low{i}"), F.col(f"high{i}")), i) for i in range(n)]
        parts.append(held.select(*keys, F.explode(F.array_compact(F.array(*places))).alias("place"), "x"))
        known = known.unionByName(solved.select(*known.columns))
    counted = reduce(DataFrame.unionByName, parts).groupBy(*keys, "place", "x").agg(F.count("*").alias("times"))
    upto = F.sum("times").over(W.partitionBy(*keys, "place").orderBy("x"))
    rows = _with_state(counted.withColumn("upto", upto), known, keys)
    ends = []
    for i in range(n):
        mine = F.col("place").isin(-1, i)
        reach = F.col("upto") + F.col(f"below{i}")
        for end, rank in (("lo", F.floor(F.col(f"at{i}"))), ("hi", F.ceil(F.col(f"at{i}")))):
            ends.append(F.min(F.when(mine & (reach > rank), F.col("x"))).alias(f"{end}{i}"))
    read = rows.groupBy(*keys).agg(*ends, *[F.first(f"at{i}").alias(f"at{i}") for i in range(n)])
    found = {}
    for i in range(n):
        low, high, up = F.col(f"lo{i}"), F.col(f"hi{i}"), F.col(f"at{i}") - F.floor(F.col(f"at{i}"))
        found[f"q{i}"] = F.when(up == 0, low).otherwise(low * (1 - up) + high * up)
    empty = sizes.filter("n = 0").select(*keys, *[F.lit(None).cast("double").alias(q) for q in found])
    result = read.select(*keys, *[c.alias(q) for q, c in found.items()]).unionByName(empty)
    return result.toDF(*by, *found) if by else result.drop(*keys)
