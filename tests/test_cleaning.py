from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from plumbline.config import DEFAULTS
from plumbline.functions.parsing import parse_number, parse_timestamp
from plumbline.operators import joins, nulls, outliers, rows, types
from plumbline.operators.profile import ColumnProfile, Profile, profile
from tests.conftest import column, same_rows


def _table(spark, values, dtype="double"):
    return spark.createDataFrame(list(enumerate(values)), f"row_id bigint, col {dtype}")


# Names and duplicates


@pytest.mark.parametrize(
    "names, expected",
    [
        (["First Name", "Last-Name", "Age!"], ["first_name", "last_name", "age"]),
        (["name", "age"], ["name", "age"]),
        ([" First  Name", "Prix (€)", "é-à"], ["first_name", "prix_", "é_à"]),
        (["Age!", "age", "AGE"], ["age", "age_2", "age_3"]),
        (["!!", "a"], ["col_0", "a"]),
    ],
)
def test_standard_names(names, expected):
    assert rows.standard_names(names) == expected


@pytest.mark.parametrize("limit", [0, 1, 100])
def test_drop_duplicates(spark, people, limit):
    table = people.drop("row_id")
    assert rows.drop_duplicates(table, limit).count() == 4
    assert rows.count_duplicates(table, limit) == 1
    assert rows.drop_duplicates(people, limit).count() == 5
    hot = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 100).alias("a"),
        F.when(F.col("id") % 2 == 0, -0.0).otherwise(0.0).alias("z"),
    )
    assert rows.count_duplicates(hot, limit) == 1000 - hot.distinct().count()
    assert same_rows(rows.drop_duplicates(hot, limit), hot.distinct())


# Types


def test_parse_number(spark):
    texts = [" 12 ", "1e3", "inf", ".5", "5.", "+5", "nan", "", "1,000", "True", "0x10", "1_0", "1d", "1f", None]
    found = column(_table(spark, texts, "string").withColumn("n", parse_number(F.col("col"))), "n")
    assert found == [12.0, 1000.0, float("inf"), 0.5, 5.0, 5.0] + [None] * 9


def test_parse_timestamp(spark):
    texts = ["2021-01-01", "01/02/2021", "Mar 3 2021", "2021-01-01 10:11:12", "2021-01-01T10:11:12", "2021/05/06",
             "05-Jan-2021", "March 3, 2021", "20210304", " 2021-01-01 ", "12:30", "2021-13-01", "soon", None]
    found = column(_table(spark, texts, "string").withColumn("t", parse_timestamp(F.col("col"))), "t")
    assert [str(t) for t in found[:3]] == ["2021-01-01 00:00:00", "2021-01-02 00:00:00", "2021-03-03 00:00:00"]
    assert all(t is not None for t in found[:10]) and found[10:] == [None] * 4


def test_type_issues(spark):
    df = spark.createDataFrame(
        [(i, f"{i}.0", f"2021-0{i}-01", "cat" if i % 2 else "dog", float(i)) for i in range(1, 6)],
        "row_id bigint, numeric_as_str string, date_as_str string, low_cardinality string, already_numeric double",
    )
    found = {r["column"]: r["issue"] for r in types.detect_type_issues(df, ["row_id"]).collect()}
    assert found == {"numeric_as_str": "should_be_numeric", "date_as_str": "should_be_datetime"}
    wide = types.detect_type_issues(df, ["row_id"], replace(DEFAULTS, categorical_ratio=0.5)).collect()
    assert ("low_cardinality", "should_be_categorical") in [(r["column"], r["issue"]) for r in wide]


def test_bad_values_become_null(spark):
    fixed = types.to_numeric(_table(spark, ["1", "2", "not_a_number", "4"], "string"), "col")
    assert column(fixed, "col") == [1.0, 2.0, None, 4.0]
    assert column(types.to_numeric(_table(spark, [None] * 3, "string"), "col"), "col") == [None] * 3


def test_type_fixes(spark):
    df = spark.createDataFrame([(0, "b", "x"), (1, "a", "x"), (2, None, "x")], "row_id bigint, c string, d string")
    fixed = types.apply_type_fixes(df, {"c": "should_be_categorical", "d": "unknown"})
    assert column(fixed, "c_code") == [1, 0, None] and column(fixed, "d") == ["x"] * 3


def test_codes_of_many_values(spark, monkeypatch):
    df = spark.range(400).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("s"))
    df = df.unionByName(df.limit(1).select(F.lit(None).cast("string").alias("s")))
    expected = types.to_categorical(df, "s")
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(types, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(joins, "HOT_KEYS", 2)
    assert same_rows(types.to_categorical(df, "s"), expected)
    values = sorted({r["s"] for r in df.collect() if r["s"] is not None})
    assert all(r["s_code"] == (values.index(r["s"]) if r["s"] else None) for r in expected.collect())


# Nulls


def test_null_strategies(spark):
    cases = [
        (20.0, "numeric", "high_skew", "fill_median"),
        (20.0, "numeric", "symmetric", "fill_mean"),
        (10.0, "categorical", None, "fill_mode"),
        (75.0, "numeric", "symmetric", "drop_column"),
        (10.0, "datetime", None, "fill_forward"),
        (60.0, "numeric", "symmetric", "fill_mean"),
        (10.0, "should_be_numeric", None, "drop_rows"),
    ]
    df = spark.createDataFrame(cases, "null_percent double, type_category string, skew_label string, expected string")
    assert nulls.null_strategy(df).filter("strategy <> expected").isEmpty()


def test_fills(spark):
    numbers = _table(spark, [1.0, 2.0, None, 4.0])
    assert column(nulls.fill_mean(numbers, "col"), "col")[2] == pytest.approx(7 / 3)
    assert column(nulls.fill_median(numbers, "col"), "col")[2] == 2.0
    words = _table(spark, ["cat", "cat", "dog", None], "string")
    assert column(nulls.fill_mode(words, "col"), "col")[3] == "cat"
    tie = _table(spark, ["b", "a", "a", "b", None], "string")
    assert column(nulls.fill_mode(tie, "col"), "col")[4] == "a"
    assert column(nulls.fill_mode(_table(spark, [None] * 3, "string"), "col"), "col") == [None] * 3
    gaps = _table(spark, [1.0, None, None, 4.0])
    assert column(nulls.fill_forward(gaps, "col", ["row_id"]), "col") == [1.0, 1.0, 1.0, 4.0]
    leading = _table(spark, [None, 2.0, None])
    assert column(nulls.fill_forward(leading, "col", ["row_id"]), "col") == [None, 2.0, 2.0]
    assert nulls.drop_null_rows(_table(spark, [1.0, None, 3.0, None]), "col").count() == 2
    assert column(nulls.fill_mean(_table(spark, [1.0, 2.0, 3.0]), "col"), "col") == [1.0, 2.0, 3.0]
    assert nulls.drop_column(numbers, "col").columns == ["row_id"]


def test_fills_keep_or_widen_types(spark):
    whole = _table(spark, [1, 1, None], "bigint")
    assert nulls.fill_mean(whole, "col").schema["col"].dataType.simpleString() == "double"
    assert nulls.fill_mode(whole, "col").schema["col"].dataType.simpleString() == "bigint"
    assert column(nulls.fill_mode(_table(spark, [1.5, float("nan"), None]), "col"), "col") == [1.5] * 3


def test_auto_nulls(people):
    fixed, log = nulls.auto_nulls(people, profile(people, ["row_id"]), ["row_id"])
    done = {(r[2], r[3]): r[4] for r in log.rows}
    assert done == {("Name", "fill_mode"): 1, ("Age", "fill_median"): 1, ("Join Date", "drop_rows"): 1}
    assert fixed.count() == 4 and fixed.filter("Name is null or Age is null").isEmpty()


def test_planned_nulls_skip_what_does_not_apply(people):
    plan = {"Name": "fill_mean", "Salary": "fill_mode", "Age": "guess", "gone": "fill_mode"}
    fixed, log = nulls.auto_nulls(people, None, ["row_id"], plan)
    assert same_rows(fixed, people)
    assert sorted(r[3] for r in log.rows) == [
        "fill_mean skipped: does not fit the type",
        "fill_mode skipped: no nulls",
        "fill_mode skipped: no such column",
        "guess skipped: unknown action",
    ]


# Outliers


@pytest.fixture(scope="module")
def ages(spark):
    pairs = zip([25.0, 22, 28, 24, 26, 300], [50000.0, 55000, 60000, 52000, 58000, 57000])
    data = [(i, float(a), float(s)) for i, (a, s) in enumerate(pairs)]
    return spark.createDataFrame(data, "row_id bigint, age double, salary double")


def test_iqr(ages):
    assert column(outliers.flag_iqr(ages, "age"), "is_outlier") == [False] * 5 + [True]
    assert not any(column(outliers.flag_iqr(ages, "salary"), "is_outlier"))
    assert column(outliers.cap_outliers(ages, "age"), "age")[5] == 32.375
    assert outliers.drop_outliers(ages, "age").count() == 5


def test_zscore(spark, ages):
    assert not any(column(outliers.flag_zscore(ages, "age"), "is_outlier"))
    assert sum(column(outliers.flag_zscore(ages, "age", threshold=2.0), "is_outlier")) == 1
    constant = _table(spark, [5.0] * 5)
    assert not any(column(outliers.flag_zscore(constant, "col"), "is_outlier"))
    assert not any(column(outliers.flag_iqr(constant, "col"), "is_outlier"))


def test_missing_values_are_no_outliers(spark):
    df = _table(spark, [25.0, 22.0, 28.0, 24.0, 26.0, 300.0, None])
    assert column(outliers.drop_outliers(df, "col"), "row_id") == [0, 1, 2, 3, 4, 6]
    assert column(outliers.cap_outliers(df, "col"), "col")[6] is None
    nothing = _table(spark, [None, None])
    assert outliers.drop_outliers(nothing, "col").count() == 2


def test_apply_to_profiled_columns(ages):
    known = {
        "age": ColumnProfile("age", type_category="numeric", outlier_count=1),
        "salary": ColumnProfile("salary", type_category="numeric", outlier_count=0),
    }
    fixed, log = outliers.auto_outliers(ages, Profile(6, 0, known), "cap")
    assert fixed.count() == 6 and [(r[2], r[4]) for r in log.rows] == [("age", 1)]
    _, nothing = outliers.auto_outliers(ages, Profile(6, 0, {"salary": known["salary"]}), "cap")
    assert nothing.rows == []
    dropped, _ = outliers.auto_outliers(ages, Profile(6, 0, known), "drop")
    assert dropped.count() == 5


def test_outlier_strategy(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 0)], "column string, outlier_count bigint")
    def chosen(total):
        return {r["column"]: r["strategy"] for r in outliers.outlier_strategy(df, total).collect()}

    assert chosen(101) == {"a": "drop", "b": "drop"}
    assert chosen(100) == {"a": "cap", "b": "cap"}
