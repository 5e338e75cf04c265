"""Computed columns as data: small expression trees, compiled to Spark columns.

An expression is a plain value (a literal), ``("col", name)``, ``("lit", value)`` for literals that are
tuples, or ``(operation, argument, ...)`` with an operation of OPERATIONS. Arguments are expressions, unless an
operation takes plain values there (patterns, units, types). No program text is evaluated, so a tree
can name columns and values only. Division by zero is NULL, as is a text that cannot be cast.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import ref

TYPES = ("string", "int", "bigint", "double", "boolean", "date", "timestamp", "timestamp_ntz")
UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")

# Operations over columns alone.
_COLUMNS: dict[str, Callable[..., Column]] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": F.try_divide,
    "mod": F.try_mod,
    "neg": lambda a: -a,
    "abs": F.abs,
    "floor": F.floor,
    "ceil": F.ceil,
    "sqrt": F.sqrt,
    "exp": F.exp,
    "log": F.log,
    "log1p": F.log1p,
    "pow": F.pow,
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: ~a.eqNullSafe(b),
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
    "and": lambda *a: reduce(and_, a),
    "or": lambda *a: reduce(or_, a),
    "not": lambda a: ~a,
    "is_null": lambda a: a.isNull(),
    "coalesce": F.coalesce,
    "least": F.least,
    "greatest": F.greatest,
    "upper": F.upper,
    "lower": F.lower,
    "trim": F.trim,
    "length": lambda a: F.length(a).cast("bigint"),
    "concat": F.concat,
    "contains": lambda a, b: F.contains(a, b),
    "starts_with": lambda a, b: F.startswith(a, b),
    "year": lambda a: F.year(a).cast("bigint"),
    "quarter": lambda a: F.quarter(a).cast("bigint"),
    "month": lambda a: F.month(a).cast("bigint"),
    "day": lambda a: F.day(a).cast("bigint"),
    "hour": lambda a: F.hour(a).cast("bigint"),
    "weekday": lambda a: F.weekday(a).cast("bigint"),  # 0 is Monday
    "days_between": lambda late, early: F.date_diff(late, early).cast("bigint"),
}


def _chosen(value: object, allowed: tuple, what: str) -> str:
    if value not in allowed:
        raise ValueError(f"unknown {what}: {value!r}")
    return value


def _case(*parts: object) -> Column:
    """``("case", (condition, value), ..., otherwise)``; the last part stands for all other rows."""
    *branches, other = parts
    if not branches:
        raise ValueError("a case needs a condition")
    result = None
    for test, value in branches:
        step = result.when if result is not None else F.when
        result = step(compiled(test), compiled(value))
    return result.otherwise(compiled(other))


# Operations with plain values: patterns, positions, units, types.
_MIXED: dict[str, Callable[..., Column]] = {
    "col": ref,
    "lit": F.lit,
    "case": _case,
    "in": lambda a, values: compiled(a).isin(list(values)),
    "between": lambda a, low, high: compiled(a).between(compiled(low), compiled(high)),
    "round": lambda a, digits=0: F.round(compiled(a), digits),
    "replace": lambda a, pattern, new: F.regexp_replace(compiled(a), F.lit(pattern), F.lit(new)),
    "matches": lambda a, pattern: compiled(a).rlike(pattern),
    "substring": lambda a, start, size: F.substring(compiled(a), start, size),
    "part": lambda a, separator, place: F.get(F.split(compiled(a), separator), F.lit(place)),
    "words": lambda a, separator: F.filter(F.split(compiled(a), separator), lambda w: w != ""),
    "truncate": lambda a, unit: F.date_trunc(_chosen(unit, UNITS, "unit"), compiled(a)),
    "add_days": lambda a, days: F.date_add(compiled(a), days),
    "cast": lambda a, kind: compiled(a).try_cast(_chosen(kind, TYPES, "type")),
    "json": lambda a, path: F.get_json_object(compiled(a), path),
}

OPERATIONS = (*_COLUMNS, *_MIXED)


def compiled(tree: object) -> Column:
    """The column that an expression stands for."""
    if not isinstance(tree, (tuple, list)):
        return F.lit(tree)
    if not tree or not isinstance(tree[0], str) or tree[0] not in OPERATIONS:
        raise ValueError(f"unknown expression: {tree!r}")
    name, *arguments = tree
    try:
        if name in _MIXED:
            return _MIXED[name](*arguments)
        return _COLUMNS[name](*map(compiled, arguments))
    except TypeError as error:
        raise ValueError(f"wrong arguments: {tree!r}") from error
