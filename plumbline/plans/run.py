"""The whole way from a raw table to its cleaned, analysed form."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Thresholds
from ..operators.dashboard import dashboard
from ..operators.features import suggest_features
from ..operators.profile import Profile, profile
from ..operators.rows import standard_names
from ..operators.target import class_distribution, feature_correlations, target_summary
from ..operators.types import detect_type_issues
from ..session import materialize
from .execute import apply_plan
from .rules import build_plan, override_plan, validate_plan


@dataclass
class Cleaning:
    """Everything a cleaning run produces; tables stay lazy where they are large."""

    profile: Profile
    plan: DataFrame
    warnings: DataFrame
    cleaned: DataFrame
    log: DataFrame
    cleaned_profile: Profile | None = None
    target: dict[str, DataFrame] = field(default_factory=dict)
    charts: dict[str, DataFrame] = field(default_factory=dict)


def propose(
    df: DataFrame,
    order_by: Sequence[str],
    overrides: dict[str, str] | None = None,
    categorical: bool = False,
    approx: bool = False,
    limits: Thresholds = DEFAULTS,
) -> tuple[Profile, DataFrame]:
    """Profile a table and derive its plan, nothing executed yet."""
    spark = df.sparkSession
    found = profile(df, order_by, approx, limits=limits)
    issues = detect_type_issues(df, order_by, limits, approx) if categorical else None
    plan = build_plan(spark, found, issues, limits)
    if overrides:
        chosen = spark.createDataFrame(list(overrides.items()), "column string, action string")
        plan = override_plan(plan, chosen)
    return found, plan


def clean(
    df: DataFrame,
    order_by: Sequence[str],
    target: str | None = None,
    overrides: dict[str, str] | None = None,
    categorical: bool = False,
    approx: bool = False,
    analyse: bool = True,
    limits: Thresholds = DEFAULTS,
) -> Cleaning:
    """Profile, plan, check, execute; then profile, analyse and chart the result.

    ``order_by`` and ``target`` are names of the raw table; the target is followed
    through the renaming.
    """
    found, plan = propose(df, order_by, overrides, categorical, approx, limits)
    # What orders the rows stays, however sparse it is.
    plan = plan.filter(~(F.col("column").isin(list(order_by)) & (F.col("action") == "drop_column")))
    cleaned, log = apply_plan(df, plan, order_by, limits)
    if analyse:
        cleaned = materialize(cleaned)  # read by many passes
    result = Cleaning(found, plan, validate_plan(plan, df), cleaned, log)
    if not analyse:
        return result
    names = dict(zip(df.columns, standard_names(df.columns)))
    order = [names[c] for c in order_by if names[c] in cleaned.columns]
    result.cleaned_profile = profile(cleaned, order, approx, limits=limits)
    result.charts = dashboard(cleaned, result.cleaned_profile, order[0], limits)
    goal = names.get(target) if target else None
    if goal in cleaned.columns:
        result.target = {
            "summary": target_summary(cleaned, goal, limits),
            "correlations": feature_correlations(cleaned, goal, limits),
            "suggestions": suggest_features(cleaned, goal, limits),
        }
        if result.target["summary"].first()["task_type"] == "classification":
            result.target["classes"] = class_distribution(cleaned, goal)
    return result
