"""Structured questions over one table (Q1-Q10)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import WIDE_AGG_COLUMNS
from ..functions.columns import as_double, batches, numeric_columns, ref, require_columns
from ..functions.group_quantiles import group_quantiles
from ..functions.quantiles import exact_quantiles
from .dashboard import correlation_matrix
from .expressions import compiled
from .profile import null_profile

COMPARISONS = {
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "==": lambda c, v: c == v,
    "!=": lambda c, v: ~c.eqNullSafe(v),  # a missing value differs from any other
    "in": lambda c, v: c.isin(list(v)),
    "between": lambda c, v: c.between(v[0], v[1]),
    "contains": lambda c, v: c.contains(v),
    "matches": lambda c, v: c.rlike(v),
    "is_null": lambda c, v: c.isNull() if v else c.isNotNull(),
}

AGGREGATES = {
    "count": F.count,
    "nunique": F.count_distinct,
    "sum": F.sum,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "var": F.var_samp,
}

# Aggregates that are not one Spark function: the median and quantiles of all groups, modes, and
# the first or last value by an order.
RANKED = ("median", "quantile")
ORDERED = ("first", "last")

GROUPINGS = ("cube", "rollup")

CHARTS = ("bar", "line", "histogram", "scatter", "none")


def condition(tests: Sequence[tuple]) -> Column:
    """All of the tests together.

    A test is ``(column, comparison, value)``, or ``("any", tests)``, ``("all", tests)`` or
    ``("not", tests)`` (not all of them) over further tests.
    """
    return reduce(and_, [_test(t) for t in tests], F.lit(True))


def _test(test: tuple) -> Column:
    if len(test) == 2 and test[0] in ("any", "all", "not"):
        kind, inner = test
        if kind == "any":
            return reduce(or_, [_test(t) for t in inner], F.lit(False))
        return ~condition(inner) if kind == "not" else condition(inner)
    if len(test) != 3 or test[1] not in COMPARISONS:
        raise ValueError(f"unknown comparison: {test!r}")
    column, comparison, value = test
    return COMPARISONS[comparison](ref(column), value)


def group_mean(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean per group in group order; rows without a group are left out."""
    return run_query(
        df,
        {
            "where": [(by, "is_null", False)],
            "group_by": [by],
            "aggs": {f"mean_{value}": ("mean", value)},
            "order_by": [by],
        },
    )


def filter_rows(df: DataFrame, column: str, comparison: str, value: object) -> DataFrame:
    return df.filter(condition([(column, comparison, value)]))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``(value, count)`` in value order, missing values left out."""
    return (
        df.filter(ref(column).isNotNull())
        .groupBy(ref(column).alias("value"))
        .agg(F.count("*").alias("count"))
        .orderBy("value")
    )


def percentage(df: DataFrame, test: Column) -> DataFrame:
    """Share of rows that pass a test, in percent; rows without an answer do not count."""
    return df.agg((F.avg(test.cast("int")) * 100).alias("percent"))


def pair_correlation(df: DataFrame, left: str, right: str) -> DataFrame:
    return correlation_matrix(df, [left, right])


def null_counts(df: DataFrame) -> DataFrame:
    return null_profile(df).select("column", "null_count")


def chart_series(df: DataFrame, chart: str, category: str | None = None, value: str | None = None):
    """Chart-shaped result, or None where no chart applies.

    bar, line and histogram take ``(category, value)``; scatter takes the first two
    columns as they are.
    """
    if chart not in CHARTS:
        raise ValueError(f"unknown chart: {chart}")
    if chart == "none" or len(df.columns) < 2:
        return None
    category, value = category or df.columns[0], value or df.columns[1]
    if chart == "scatter":
        return df.select(ref(category), ref(value))
    return df.select(ref(category).alias("category"), as_double(value).alias("value"))


def run_query(df: DataFrame, spec: dict, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run a specification over a table, its parts in this order.

    ``where``: tests; ``compute``: {name: expression}; ``explode``: (name, expression of an array);
    ``melt``: ``{"keep": names, "values": names}`` to rows of ``variable`` and ``value``;
    ``semi`` / ``anti``: ``(specification, {column: its column})``, rows with or without a match;
    ``union`` / ``intersect`` / ``except``: a specification, columns by name (only union keeps repeated rows);
    ``group_by`` with ``grouping`` ("cube" or "rollup") and ``aggs``: {name: (aggregate, column, ...)}, where
    "*" counts rows, ("quantile", column, share), ("first", column, order columns);
    ``pivot``: ``(column, values)``, one column of the only aggregate for each value;
    ``having``, ``compute_after``, ``select``, ``distinct``, ``order_by`` (a leading minus for descending)
    and ``limit``. ``from`` starts from a specification or from another table of ``tables``, in nested ones too.

    A specification can name columns and values but no code, so it cannot change anything.
    """
    unknown = set(spec) - set(_PARTS)
    if unknown:
        raise ValueError(f"unknown parts: {', '.join(sorted(unknown))}")
    start = spec.get("from")
    if isinstance(start, dict):
        df = run_query(df, start, tables)
    elif start is not None:
        if start not in (tables or {}):
            raise ValueError(f"unknown table: {start}")
        df = tables[start]
    if spec.get("group_by"):
        spec = {"aggs": {}} | spec
    for part in _PARTS:
        asked = spec.get(part)
        if part in _STEPS and asked is not None and asked != []:
            df = _STEPS[part](df, spec, tables)
    return df


def _joined(kind: str):
    def step(df: DataFrame, spec: dict, tables) -> DataFrame:
        inner, on = spec[kind]
        # A hot key is one row.
        keys = run_query(df, inner, tables).select(*[ref(c).alias(f"_{i}") for i, c in enumerate(on.values())]).distinct()
        same = reduce(and_, [ref(c) == F.col(f"_{i}") for i, c in enumerate(on)])
        return df.join(keys, same, f"left_{kind}")

    return step


def _combined(kind: str):
    def step(df: DataFrame, spec: dict, tables) -> DataFrame:
        other = run_query(df, spec[kind], tables)
        require_columns(other, df.columns)
        if kind == "union":
            return df.unionByName(other)
        # Distinct rows of both sides first, so that a hot row is one row.
        left, right = df.distinct(), other.select(*[ref(c) for c in df.columns]).distinct()
        return left.intersect(right) if kind == "intersect" else left.subtract(right)

    return step


def _computed(df: DataFrame, trees: dict) -> DataFrame:
    return df.withColumns({name: compiled(tree) for name, tree in trees.items()})


def _exploded(df: DataFrame, spec: dict, _) -> DataFrame:
    name, tree = spec["explode"]
    return df.withColumn(name, F.explode(compiled(tree)))


def _melted(df: DataFrame, spec: dict, _) -> DataFrame:
    keep, values = spec["melt"]["keep"], spec["melt"]["values"]
    return df.unpivot([ref(c) for c in keep], [ref(c) for c in values], "variable", "value")


def _aggregate(name: str, parts: tuple) -> Column:
    function, column, *more = parts
    if function in ORDERED and more:
        order, value = F.struct(*[ref(c) for c in more[0]]), ref(column)
        pick = F.min_by if function == "first" else F.max_by
        return pick(value, F.when(value.isNotNull(), order)).alias(name)
    if function not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {function}")
    return AGGREGATES[function](F.lit(1) if column == "*" else ref(column)).alias(name)


def _pivoted(df: DataFrame, spec: dict, aggs: dict) -> DataFrame:
    column, values = spec["pivot"]
    if len(aggs) != 1:
        raise ValueError("a pivot takes one aggregate")
    ((_, parts),) = aggs.items()
    table = df.groupBy(*[ref(c) for c in spec.get("group_by", [])]).pivot(column, list(values))
    return table.agg(_aggregate("value", parts))


def _modes(df: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """The most frequent value of each group, the smallest of equally frequent ones."""
    value = ref(column).alias("_value")
    counted = df.select(*[ref(c) for c in by], value).groupBy(*[ref(c) for c in by], "_value").agg(F.count("*").alias("_n"))
    rank = F.when(F.col("_value").isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col("_value").alias("value")))
    return counted.groupBy(*[ref(c) for c in by]).agg(F.min(rank)["value"].alias(name))


def _grouped(df: DataFrame, spec: dict, _) -> DataFrame:
    by, aggs = list(spec.get("group_by", [])), dict(spec.get("aggs", {}))
    require_columns(df, by)
    if spec.get("pivot"):
        return _pivoted(df, spec, aggs)
    whole = {n: p for n, p in aggs.items() if p[0] in RANKED or p[0] == "mode"}
    plain = [_aggregate(n, p) for n, p in aggs.items() if n not in whole]
    keys = [ref(c) for c in by]
    grouping = spec.get("grouping")
    if grouping is not None:
        if grouping not in GROUPINGS or whole:
            raise ValueError(f"unknown grouping, or not with these aggregates: {grouping}")
        return getattr(df, grouping)(*keys).agg(*plain)
    if not whole:
        return df.groupBy(*keys).agg(*plain) if plain else df.select(*keys).distinct()
    # One row per group on each side of the joins.
    parts = [df.groupBy(*keys).agg(*plain)] if plain else []
    shares: dict[str, dict[str, float]] = {}
    for name, (function, column, *more) in whole.items():
        if function == "mode":
            parts.append(_modes(df, by, column, name))
        else:
            shares.setdefault(column, {})[name] = more[0] if function == "quantile" else 0.5
    for column, asked in shares.items():
        found = group_quantiles(df, by, as_double(column) if column in numeric_columns(df) else ref(column), list(asked.values()))
        parts.append(found.toDF(*by, *asked))
    result = parts[0]
    for k, part in enumerate(parts[1:]):
        names = [f"_{k}_{i}" for i in range(len(by))]
        part = part.toDF(*names, *part.columns[len(by) :])
        same = reduce(and_, [ref(c).eqNullSafe(F.col(m)) for c, m in zip(by, names)], F.lit(True))
        result = result.join(part, same).drop(*names) if by else result.crossJoin(part)  # one row each without groups
    return result.select(*keys, *[ref(n) for n in aggs])


def _ordered_by(df: DataFrame, spec: dict, _) -> DataFrame:
    return df.orderBy(*[ref(c[1:]).desc() if c.startswith("-") else ref(c).asc() for c in spec["order_by"]])


def _selected(df: DataFrame, spec: dict, _) -> DataFrame:
    require_columns(df, spec["select"])
    return df.select(*[ref(c) for c in spec["select"]])


_PARTS = (
    "from", "where", "compute", "explode", "melt", "semi", "anti", "union", "intersect", "except",
    "group_by", "grouping", "pivot", "aggs", "having", "compute_after", "select", "distinct", "order_by", "limit",
)

_STEPS = {
    "semi": _joined("semi"),
    "anti": _joined("anti"),
    "union": _combined("union"),
    "intersect": _combined("intersect"),
    "except": _combined("except"),
    "where": lambda df, spec, _: df.filter(condition(spec["where"])),
    "compute": lambda df, spec, _: _computed(df, spec["compute"]),
    "explode": _exploded,
    "melt": _melted,
    "aggs": _grouped,
    "having": lambda df, spec, _: df.filter(condition(spec["having"])),
    "compute_after": lambda df, spec, _: _computed(df, spec["compute_after"]),
    "select": _selected,
    "distinct": lambda df, spec, _: df.distinct() if spec["distinct"] else df,
    "order_by": _ordered_by,
    "limit": lambda df, spec, _: df.limit(spec["limit"]),
}
PERIODS = ("year", "quarter", "month", "week", "day", "hour")


def resample(df: DataFrame, time: str, unit: str, aggs: dict[str, tuple], by: Sequence[str] = ()) -> DataFrame:
    """Aggregates per calendar period and group, with a row for every period from a group's first to its last.

    Periods without rows count and add up to 0; other aggregates are NULL there. Rows without a time are
    left out. ``period`` is the start of the period; ``aggs`` are those of ``run_query``.
    """
    if unit not in PERIODS:
        raise ValueError(f"unknown period: {unit}")
    require_columns(df, [time, *by])
    keys = [ref(c) for c in by]
    start = F.date_trunc(unit, ref(time)).alias("period")
    found = df.filter(ref(time).isNotNull()).withColumn("period", start).groupBy(*keys, "period")
    found = found.agg(*[_aggregate(n, p) for n, p in aggs.items()])
    # One row per group and period on both sides of the join.
    step = F.expr({"quarter": "INTERVAL 3 MONTH", "week": "INTERVAL 7 DAY"}.get(unit, f"INTERVAL 1 {unit.upper()}"))
    names = [f"_{i}" for i in range(len(by))]
    ends = found.groupBy(*keys).agg(F.min("period").alias("_from"), F.max("period").alias("_to"))
    spine = ends.filter(F.col("_from").isNotNull()).select(
        *[k.alias(n) for k, n in zip(keys, names)], F.explode(F.sequence("_from", "_to", step)).alias("_period")
    )
    same = reduce(and_, [F.col(n).eqNullSafe(k) for n, k in zip(names, keys)], F.col("_period") == F.col("period"))
    zero = [n for n, p in aggs.items() if p[0] in ("count", "nunique", "sum")]
    filled = [F.coalesce(ref(n), F.lit(0)).alias(n) if n in zero else ref(n) for n in aggs]
    return spine.join(found, same, "left").select(
        *[F.col(n).alias(c) for n, c in zip(names, by)], F.col("_period").cast("timestamp_ntz").alias("period"), *filled
    )


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, count, mean, std, min, q1, median, q3, max)`` of the numeric columns.

    Quartiles are exact and interpolated; NULL and NaN are left out. A column without
    values has a count of 0 and NULL otherwise.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    require_columns(df, columns)
    values = {c: as_double(c) for c in columns}
    parts = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    found = {}
    for group in batches(columns, WIDE_AGG_COLUMNS // len(parts)):
        row = df.agg(*[f(values[c]) for c in group for f in parts.values()]).first()
        found.update({c: row[i * len(parts) : (i + 1) * len(parts)] for i, c in enumerate(group)})
    quartiles = exact_quantiles(df, values, [0.25, 0.5, 0.75], {c: found[c][0] for c in columns})
    rows = [(c, *found[c][:4], *quartiles[c], found[c][4]) for c in columns]
    numbers = ", ".join(f"{n} double" for n in ("mean", "std", "min", "q1", "median", "q3", "max"))
    return df.sparkSession.createDataFrame(rows, f"column string, count bigint, {numbers}")


ENGINE = "org.apache.spark.sql.catalyst.expressions."
# Leaves of a plan that hold no stored data.
OWN_LEAVES = ("OneRowRelation", "LocalRelation", "CTERelationRef", "Range")
# Nodes that hold a query inside an expression.
NESTED = ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery")
# Expressions of the engine that run code from outside of it.
OUTSIDE = (
    "CallMethodViaReflection", "TryReflect", "ScalaUDF", "PythonUDF", "PythonUDAF", "PythonUDTF",
    "UnresolvedPolymorphicPythonUDTF", "ApplyFunctionExpression", "InputFileName", "InputFileBlockStart", "InputFileBlockLength",
)


def _items(sequence) -> Iterator:
    return (sequence.apply(i) for i in range(sequence.size()))


def _qualified(plan) -> Iterator[str]:
    """Relations of a parsed plan that are named by more than one part: catalogs, files."""
    if plan.getClass().getSimpleName() == "UnresolvedRelation" and plan.multipartIdentifier().size() > 1:
        yield ".".join(_items(plan.multipartIdentifier()))
    for child in [*_items(plan.children()), *_items(plan.innerChildren())]:
        yield from _qualified(child)
    for expression in _items(plan.expressions()):
        for nested in _plans_in(expression):
            yield from _qualified(nested)


def _plans_in(expression) -> Iterator:
    if expression.getClass().getSimpleName() in NESTED:
        yield expression.plan()
    for child in _items(expression.children()):
        yield from _plans_in(child)


def _refused(plan, given: str) -> Iterator[str]:
    """What a resolved plan reads or calls beyond the given view and the engine's own functions."""
    kind = plan.getClass().getSimpleName()
    if kind == "SubqueryAlias" and plan.alias() == given:
        return
    children = list(_items(plan.children()))
    if not children and kind not in OWN_LEAVES:
        yield f"the table of {kind}"
    for expression in _items(plan.expressions()):
        yield from _refused_calls(expression, given)
    for child in children:
        yield from _refused(child, given)


def _refused_calls(expression, given: str) -> Iterator[str]:
    kind, name = expression.getClass().getSimpleName(), expression.getClass().getName()
    if not name.startswith(ENGINE) or kind in OUTSIDE:
        yield f"the function {kind}"
    if kind in NESTED:
        yield from _refused(expression.plan(), given)
    for child in _items(expression.children()):
        yield from _refused_calls(child, given)


def run_sql(df: DataFrame, text: str) -> DataFrame:
    """Run a SELECT that names the table as ``{df}``.

    The text is placed where only a query can stand, so statements that change or define
    anything do not parse. The resolved plan is walked before anything runs: its leaves must be the
    given table or hold no stored data (VALUES, ranges, tables that the text defines by WITH from
    these), and its functions must be the engine's own, without those that run outside code. Names of
    several parts (files, other catalogs) are refused before they are looked up.
    """
    if "{df}" not in text:
        raise ValueError("name the table as {df}")
    spark, given = df.sparkSession, f"given_{uuid.uuid4().hex}"
    statement = "SELECT * FROM (\n" + text.replace("{df}", given) + "\n)"
    qualified = sorted(set(_qualified(spark._jsparkSession.sessionState().sqlParser().parsePlan(statement))))
    if qualified:
        raise ValueError(f"only the given table can be read, not {', '.join(qualified)}")
    df.createOrReplaceTempView(given)
    try:
        result = spark.sql(statement)
        refused = sorted(set(_refused(result._jdf.queryExecution().analyzed(), given)))
    finally:
        spark.catalog.dropTempView(given)
    if refused:
        raise ValueError(f"only the given table and plain functions can be used, not {', '.join(refused)}")
    return result
