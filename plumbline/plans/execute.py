"""Run a cleaning plan.

Fixes are sequential: a removed row changes the statistics of every later column, while
filling or capping one column leaves the others alone. Actions are therefore collected
into segments that share their statistics passes; only an action that removes rows, or
a second action on the same column, starts a new one. Where a segment follows a shuffle
(duplicates, forward fill), the table is written once so that the statistics passes
read the columns they need instead of repeating the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, WIDE_AGG_COLUMNS, Thresholds
from ..functions.columns import as_double, batches, is_numeric, ref, types_of
from ..functions.counts import modes
from ..functions.quantiles import exact_quantiles
from ..operators.nulls import STRATEGIES, fits, replace_null
from ..operators.ordered import forward_fill
from ..operators.outliers import capped
from ..operators.profile import count_outside, fences, null_mask, outside
from ..operators.rows import drop_duplicates, standard_names
from ..operators.types import apply_type_fixes
from ..session import materialize

LOG_SCHEMA = "seq int, stage string, column string, action string, rows_affected bigint"


@dataclass(frozen=True)
class Action:
    seq: int
    stage: str
    column: str
    action: str

    @property
    def removes_rows(self) -> bool:
        return self.action in ("drop_rows", "drop")


@dataclass
class Log:
    """What was done, in order; skipped actions are logged with their reason."""

    rows: list[tuple] = field(default_factory=list)

    def add(self, action: Action, affected: int | None, note: str = "") -> None:
        name = f"{action.action} skipped: {note}" if note else action.action
        self.rows.append((action.seq, action.stage, action.column, name, affected))

    def to_df(self, spark) -> DataFrame:
        return spark.createDataFrame(sorted(self.rows, key=lambda r: r[0]), LOG_SCHEMA)


def segments(actions: Sequence[Action]) -> list[list[Action]]:
    """Cut the plan where an action needs statistics that earlier ones change."""
    result: list[list[Action]] = []
    closed = True
    for action in actions:
        if closed or any(a.column == action.column for a in result[-1]):
            result.append([])
        result[-1].append(action)
        closed = action.removes_rows
    return result


def run_actions(
    df: DataFrame,
    actions: Sequence[Action],
    order_by: Sequence[str],
    limits: Thresholds = DEFAULTS,
    log: Log | None = None,
    shuffled: bool = False,
) -> tuple[DataFrame, Log]:
    """Run null and outlier actions in order; ``shuffled`` marks an expensive input."""
    log = log or Log()
    for segment in segments(actions):
        if shuffled:
            df, shuffled = materialize(df), False
        df, shuffled = _run_segment(df, segment, order_by, limits, log)
    return df, log


def _run_segment(
    df: DataFrame, segment: list[Action], order_by: Sequence[str], limits: Thresholds, log: Log
) -> tuple[DataFrame, bool]:
    types = types_of(df)
    actions = []
    for a in segment:
        if a.column not in types:
            log.add(a, None, "no such column")
        elif a.stage == "outliers" and not is_numeric(types[a.column]):
            log.add(a, None, "not numeric")
        elif a.stage == "outliers" and a.action not in ("cap", "drop"):
            log.add(a, None, "unknown action")
        elif a.stage == "nulls" and a.action not in STRATEGIES:
            log.add(a, None, "unknown action")
        elif a.stage == "nulls" and not fits(a.action, types[a.column]):
            log.add(a, None, "does not fit the type")
        else:
            actions.append(a)

    # One pass: what is missing, and the means.
    asked = [a for a in actions if a.stage == "nulls"]
    missing: dict[str, int] = {}
    means: dict[str, float | None] = {}
    for group in batches(asked, WIDE_AGG_COLUMNS):
        row = df.agg(
            *[F.count_if(null_mask(df, a.column)).alias(f"n{i}") for i, a in enumerate(group)],
            *[
                F.avg(as_double(a.column)).alias(f"m{i}")
                for i, a in enumerate(group)
                if a.action == "fill_mean"
            ],
        ).first().asDict()
        for i, a in enumerate(group):
            missing[a.column] = row[f"n{i}"]
            means[a.column] = row.get(f"m{i}")
    todo = [a for a in actions if a.stage == "outliers" or missing[a.column] > 0]
    for a in actions:
        if a not in todo:
            log.add(a, None, "no nulls")

    medians = exact_quantiles(
        df, {a.column: as_double(a.column) for a in todo if a.action == "fill_median"}, [0.5]
    )
    common = modes(df, [a.column for a in todo if a.action == "fill_mode"])
    bounded = {a.column: as_double(a.column) for a in todo if a.stage == "outliers"}
    limits_of = fences(df, bounded, limits.iqr_multiplier)
    outliers = count_outside(df, bounded, limits_of)

    changes, dropped, forward, keep = {}, [], [], None
    for a in todo:
        c = a.column
        affected = missing.get(c, 0)
        if a.action == "fill_mean":
            changes[c] = replace_null(df, c, means[c])
        elif a.action == "fill_median":
            changes[c] = replace_null(df, c, medians[c][0])
        elif a.action == "fill_mode":
            changes[c] = replace_null(df, c, common[c])
        elif a.action == "fill_forward":
            forward.append(c)
        elif a.action == "drop_column":
            dropped.append(c)
        elif a.action == "drop_rows":
            keep = ~null_mask(df, c)
        elif a.action == "cap":
            changes[c] = capped(bounded[c], *limits_of[c][:2])
            affected = outliers[c]
        elif a.action == "drop":
            keep = ~outside(bounded[c], *limits_of[c][:2])
            affected = outliers[c]
        log.add(a, affected)

    # Only the last action of a segment removes rows; forward fills see all of them.
    order = [k for k in order_by if k in df.columns]
    if forward:
        if not order:
            raise ValueError("a forward fill needs order_by columns that are in the table")
        df = forward_fill(df, forward, order)
    if keep is not None:
        df = df.filter(keep)
    df = df.select(*[changes.get(c, ref(c)).alias(c) for c in df.columns if c not in dropped])
    return df, bool(forward)


def apply_plan(
    df: DataFrame,
    plan: DataFrame,
    order_by: Sequence[str],
    limits: Thresholds = DEFAULTS,
) -> tuple[DataFrame, DataFrame]:
    """Execute a plan: duplicates, names, types, nulls, outliers. Returns table and log.

    ``order_by`` names the row order in the input's column names.
    """
    spark = df.sparkSession
    rows = plan.orderBy("seq").collect()  # a few rows per column
    log, shuffled, order = Log(), False, list(order_by)
    names = {c: c for c in df.columns}

    for r in (r for r in rows if r["stage"] == "duplicates"):
        kept = materialize(drop_duplicates(df))
        log.add(Action(r["seq"], r["stage"], None, r["action"]), df.count() - kept.count())
        df = kept
    for r in (r for r in rows if r["stage"] == "names"):
        names = dict(zip(df.columns, standard_names(df.columns)))
        order = [names[c] for c in order]
        df = df.toDF(*names.values())
        changed = sum(old != new for old, new in names.items())
        log.add(Action(r["seq"], r["stage"], None, r["action"]), None if not changed else 0)

    def actions(*stages: str) -> list[Action]:
        return [
            Action(r["seq"], r["stage"], names.get(r["column"], r["column"]), r["action"])
            for r in rows
            if r["stage"] in stages
        ]

    fixes = {}
    for a in actions("types"):
        if a.column in df.columns:
            fixes[a.column] = a.action
            log.add(a, None)
        else:
            log.add(a, None, "no such column")
    df = apply_type_fixes(df, fixes)
    df, log = run_actions(df, actions("nulls", "outliers"), order, limits, log, shuffled)
    return df, log.to_df(spark)
