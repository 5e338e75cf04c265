from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.plans.execute import Action, apply_plan, run_actions, segments
from plumbline.plans.rules import build_plan, name_map, override_plan, remap_plan, validate_plan
from plumbline.plans.run import clean, propose
from plumbline.operators.profile import profile
from tests.conftest import column


@pytest.fixture(scope="module")
def messy(spark):
    rows = spark.range(600).select(
        F.col("id").alias("Row ID"),
        F.when(F.col("id") % 10 == 0, None).when(F.col("id") == 7, 1e6).otherwise(F.col("id") * 1.0).alias("Price ($)"),
        F.when(F.col("id") % 4 == 0, None).otherwise(F.concat(F.lit("c"), F.col("id") % 3)).alias("Kind"),
        F.when(F.col("id") % 50 == 1, "?").otherwise(F.col("id").cast("string")).alias("Code"),
        F.when(F.col("id") % 3 == 0, 1).alias("Rare"),
        F.expr("DATE '2024-01-01' + CAST(id % 30 AS INT)").cast("string").alias("Day"),
    )
    return rows.unionByName(rows.filter("`Row ID` < 5"))


def _rows(plan):
    return [(r["stage"], r["column"], r["action"]) for r in plan.orderBy("seq").collect()]


def test_plan(spark, messy):
    _, plan = propose(messy, ["Row ID"])
    assert _rows(plan) == [
        ("duplicates", None, "drop_duplicates"),
        ("names", None, "standardize"),
        ("types", "Code", "should_be_numeric"),
        ("types", "Day", "should_be_datetime"),
        ("nulls", "Price ($)", "fill_median"),
        ("nulls", "Kind", "fill_mode"),
        ("nulls", "Rare", "drop_column"),
        ("outliers", "Price ($)", "drop"),
    ]
    with_categories = _rows(propose(messy, ["Row ID"], categorical=True)[1])
    assert ("types", "Kind", "should_be_categorical") in with_categories


def test_warnings_and_overrides(spark, messy):
    _, plan = propose(messy, ["Row ID"])
    assert validate_plan(plan, messy).isEmpty()
    absent = {(r["stage"], r["column"]) for r in validate_plan(plan, messy.drop("Code", "Kind")).collect()}
    assert absent == {("types", "Code"), ("nulls", "Kind")}
    chosen = spark.createDataFrame([("Kind", "fill_mean"), ("Day", "drop_rows")], "column string, action string")
    replaced = override_plan(plan, chosen)
    assert ("nulls", "Kind", "fill_mean") in _rows(replaced)
    assert ("nulls", "Day", "drop_rows") not in _rows(replaced)
    wrong = validate_plan(replaced, messy).collect()
    assert [(r["column"], r["problem"]) for r in wrong] == [("Kind", "action does not fit the type")]


def test_remap_changes_columns_only(spark, messy):
    _, plan = propose(messy, ["Row ID"])
    named = _rows(remap_plan(plan, name_map(spark, messy.columns)))
    assert ("nulls", "price_", "fill_median") in named and ("names", None, "standardize") in named


def test_segments():
    def cut(*pairs):
        actions = [Action(i, "nulls", c, a) for i, (c, a) in enumerate(pairs)]
        return [[a.column for a in s] for s in segments(actions)]

    assert cut(("a", "fill_mean"), ("b", "fill_mode"), ("a", "cap")) == [["a", "b"], ["a"]]
    assert cut(("a", "drop_rows"), ("b", "fill_mean")) == [["a"], ["b"]]
    assert cut(("a", "fill_mean"), ("b", "drop"), ("c", "cap")) == [["a", "b"], ["c"]]
    assert cut() == []


def test_execution(spark, messy):
    _, plan = propose(messy, ["Row ID"])
    cleaned, log = apply_plan(messy, plan, ["Row ID"])
    assert cleaned.columns == ["row_id", "price_", "kind", "code", "day"]
    assert cleaned.count() == 599
    done = {(r["stage"], r["column"]): r["rows_affected"] for r in log.collect()}
    assert done[("duplicates", None)] == 5 and done[("nulls", "price_")] == 60
    assert done[("nulls", "kind")] == 150 and done[("outliers", "price_")] == 1
    assert cleaned.filter("price_ is null or kind is null").isEmpty()
    # A cast may add nulls; the plan made before it leaves them.
    assert cleaned.filter("code is null").count() == 12


def test_statistics_follow_removed_rows(spark):
    df = spark.createDataFrame(
        [(0, None, 100.0), (1, 1.0, 2.0), (2, 2.0, None), (3, 3.0, 4.0)], "k bigint, a double, b double"
    )
    actions = [Action(0, "nulls", "a", "drop_rows"), Action(1, "nulls", "b", "fill_mean")]
    fixed, log = run_actions(df, actions, ["k"])
    assert column(fixed, "b", "k") == [2.0, 3.0, 4.0]
    assert [(r[2], r[4]) for r in log.rows] == [("a", 1), ("b", 1)]


def test_forward_fill_in_a_plan(spark):
    df = spark.createDataFrame([(i, None if i % 3 else float(i), float(i)) for i in range(12)], "k bigint, a double, b double")
    actions = [
        Action(0, "nulls", "a", "fill_forward"),
        Action(1, "outliers", "a", "cap"),
        Action(2, "outliers", "b", "drop"),
    ]
    fixed, log = run_actions(df, actions, ["k"])
    assert column(fixed, "a", "k") == [float(i - i % 3) for i in range(12)]
    assert [(r[3], r[4]) for r in log.rows] == [("fill_forward", 8), ("cap", 0), ("drop", 0)]


def test_whole_run(spark, messy):
    result = clean(messy, ["Row ID"], target="Kind", overrides={"Price ($)": "fill_mean"})
    assert ("nulls", "Price ($)", "fill_mean") in _rows(result.plan)
    assert result.warnings.isEmpty()
    assert result.cleaned_profile.duplicate_rows == 0
    assert result.target["summary"].first()["task_type"] == "classification"
    assert result.target["classes"].count() == 3
    assert {"nullity_matrix", "correlation_heatmap", "dist_price_", "box_price_", "bar_kind"} <= set(result.charts)
    assert result.charts["bar_kind"].count() == 3


def test_plan_of_a_clean_table(spark):
    df = spark.range(50).select("id", (F.col("id") % 7).alias("x"))
    plan = build_plan(spark, profile(df, ["id"]))
    assert _rows(plan) == [("names", None, "standardize")]
