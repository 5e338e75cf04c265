"""The cleaning plan as rules over a profile (L1-L4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, Thresholds
from ..functions.columns import is_numeric, types_of
from ..operators.nulls import STRATEGIES, fits
from ..operators.profile import Profile
from ..operators.rows import standard_names

PLAN_SCHEMA = "seq int, stage string, column string, action string, reason string"
TABLE_STAGES = ("duplicates", "names")
COLUMN_STAGES = ("types", "nulls", "outliers")


def build_plan(
    spark: SparkSession,
    profile: Profile,
    issues: DataFrame | None = None,
    limits: Thresholds = DEFAULTS,
) -> DataFrame:
    """Plan rows in execution order. ``issues`` adds conversions to categories."""
    columns = list(profile.columns)
    order = F.array(*[F.lit(c) for c in columns]) if columns else F.array().cast("array<string>")
    stats = profile.to_df(spark).withColumn("_at", F.array_position(order, F.col("column")))
    category = F.col("type_category")
    percent, skew = F.col("null_percent"), F.col("skew_label")
    percent_text = F.concat(F.format_number(percent, 2), F.lit("% missing"))

    def rows(stage: int, action: Column, reason: Column) -> DataFrame:
        return stats.select(
            F.lit(stage).alias("_stage"),
            "_at",
            F.lit(COLUMN_STAGES[stage]).alias("stage"),
            "column",
            action.alias("action"),
            reason.alias("reason"),
        ).filter(F.col("action").isNotNull())

    as_number = category.isin("numeric", "should_be_numeric")
    as_date = category.isin("datetime", "should_be_datetime")
    types = rows(
        0,
        F.when(category.isin("should_be_numeric", "should_be_datetime"), category),
        F.when(category == "should_be_numeric", "text that holds numbers").otherwise(
            "text that holds dates"
        ),
    )
    if issues is not None:
        # One row per column of the table.
        converted = issues.filter(F.col("issue") == "should_be_categorical").select("column")
        types = types.unionByName(
            stats.join(converted, "column", "left_semi").select(
                F.lit(0).alias("_stage"),
                "_at",
                F.lit("types").alias("stage"),
                "column",
                F.lit("should_be_categorical").alias("action"),
                F.lit("few distinct values").alias("reason"),
            )
        )
    nulls = rows(
        1,
        F.when(
            percent > 0,
            F.when(percent > limits.drop_column_percent, "drop_column")
            .when(as_number & skew.isin("moderate_skew", "high_skew"), "fill_median")
            .when(as_number, "fill_mean")
            .when(as_date, "fill_forward")
            .otherwise("fill_mode"),
        ),
        F.when(as_number, F.concat_ws(", ", percent_text, skew)).otherwise(percent_text),
    )
    found = F.col("outlier_count")
    share = found / F.lit(float(max(profile.rows, 1)))
    droppable = (share < limits.outlier_drop_share) & F.lit(
        profile.rows > limits.outlier_drop_min_rows
    )
    outliers = rows(
        2,
        F.when(found > 0, F.when(droppable, "drop").otherwise("cap")),
        F.concat(found.cast("string"), F.lit(" outliers")),
    )
    table = spark.createDataFrame(
        [(-2, 0, "duplicates", None, "drop_duplicates", f"{profile.duplicate_rows} duplicate rows")]
        * bool(profile.duplicate_rows)
        + [(-1, 0, "names", None, "standardize", "snake-case names")],
        "_stage int, _at bigint, stage string, column string, action string, reason string",
    )
    body = table.unionByName(types).unionByName(nulls).unionByName(outliers)
    # A few rows per column of the profiled table, ordered on the driver.
    ordered = sorted(body.collect(), key=lambda r: (r["_stage"], r["_at"]))
    return spark.createDataFrame(
        [(i, r["stage"], r["column"], r["action"], r["reason"]) for i, r in enumerate(ordered)],
        PLAN_SCHEMA,
    )


def validate_plan(plan: DataFrame, df: DataFrame) -> DataFrame:
    """``(stage, column, problem)`` for plan rows that will be skipped."""
    spark = df.sparkSession
    schema = spark.createDataFrame([(c,) for c in df.columns], "column string")
    absent = (
        plan.filter(F.col("stage").isin(*COLUMN_STAGES))
        .join(schema, "column", "left_anti")
        .select("stage", "column", F.lit("column does not exist").alias("problem"))
    )
    # Types as they will be once the planned type fixes ran.
    fixed = {
        r["column"]: r["action"]
        for r in plan.filter(F.col("stage") == "types").select("column", "action").collect()
    }
    misfits = []
    for name, dtype in types_of(df).items():
        target = fixed.get(name)
        for action in STRATEGIES:
            if target == "should_be_numeric":
                continue
            if target == "should_be_datetime":
                ok = action not in ("fill_mean", "fill_median")
            else:
                ok = fits(action, dtype)
            if not ok:
                misfits.append(("nulls", name, action))
        if target != "should_be_numeric" and not is_numeric(dtype):
            misfits += [("outliers", name, action) for action in ("cap", "drop")]
    pairs = spark.createDataFrame(misfits, "stage string, column string, action string")
    wrong = plan.join(pairs, ["stage", "column", "action"], "left_semi").select(
        "stage", "column", F.lit("action does not fit the type").alias("problem")
    )
    return absent.unionByName(wrong)


def override_plan(plan: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace null strategies of columns that have one; ``overrides(column, action)``."""
    chosen = overrides.select(
        "column", F.col("action").alias("_chosen"), F.lit("nulls").alias("stage")
    )
    replaced = F.coalesce(F.col("_chosen"), F.col("action"))
    return plan.join(chosen, ["stage", "column"], "left").select(
        "seq",
        "stage",
        "column",
        replaced.alias("action"),
        F.when(F.col("_chosen").isNotNull(), "override").otherwise(F.col("reason")).alias("reason"),
    )


def remap_plan(plan: DataFrame, names: DataFrame) -> DataFrame:
    """Plan columns under their new names; ``names(old, new)``."""
    return plan.join(names, F.col("column") == F.col("old"), "left").select(
        "seq", "stage", F.coalesce("new", "column").alias("column"), "action", "reason"
    )


def name_map(spark: SparkSession, columns: list[str]) -> DataFrame:
    return spark.createDataFrame(list(zip(columns, standard_names(columns))), "old string, new string")
