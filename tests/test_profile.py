from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.config import DEFAULTS
from plumbline.functions import counts
from plumbline.functions.columns import as_double
from plumbline.functions.counts import bounded_distinct, distinct_counts, modes, top_values, value_frequencies
from plumbline.functions.leading import first_values, leading_values
from plumbline.functions.parsing import parse_number
from plumbline.functions.quantiles import exact_quantiles
from plumbline.functions.stats import adjusted_skew, correlation_p_value
from plumbline.operators import merge
from plumbline.operators.profile import (
    column_profile,
    converted_profile,
    null_profile,
    numeric_profile,
    profile,
    summary_flags,
    table_profile,
)


def test_people(people):
    found = profile(people, ["row_id"])
    assert found.rows == 5 and len(found.columns) == 5
    assert found.columns["Age"].null_count == 1 and found.columns["Age"].null_percent == 20.0
    assert found.columns["Salary"].type_category == "should_be_numeric"
    assert found.columns["Join Date"].type_category == "should_be_datetime"
    assert found.columns["Salary"].std is None and found.columns["Salary"].mean == 57000.0
    assert found.columns["Name"].top_values == [("Alice", 2), ("Bob", 1), ("Dave", 1)]
    assert found.columns["Name"].sample_values == ["Alice", "Bob", "Dave", "Alice"]
    assert found.columns["Name"].cardinality == "low"
    assert str(found.columns["Join Date"].max_date) == "2022-03-01 00:00:00"
    assert table_profile(people.drop("row_id")).first().asDict() == {
        "rows": 5,
        "columns": 4,
        "duplicate_rows": 1,
    }


def test_approximate_profile(people):
    found = profile(people.drop("row_id"), ["Age"], approx=True)
    assert found.duplicate_rows == 1 and found.columns["Name"].unique_count == 3
    assert found.columns["Name"].top_values[0] == ("Alice", 2)


def test_table_without_columns(spark):
    empty = spark.createDataFrame([], T.StructType([]))
    assert table_profile(empty).first().asDict() == {"rows": 0, "columns": 0, "duplicate_rows": 0}
    assert profile(empty, []).columns == {}


def test_empty_table(spark):
    found = profile(spark.createDataFrame([], "k int, s string, d double"), ["k"])
    assert found.rows == 0 and found.duplicate_rows == 0
    assert found.columns["d"].null_percent is None and found.columns["d"].mean is None
    assert found.columns["d"].outlier_count == 0


def test_column_of_nulls(spark):
    df = spark.createDataFrame([(i, None) for i in range(3)], "k int, s string")
    found = profile(df, ["k"]).columns["s"]
    assert found.null_percent == 100.0 and found.unique_count == 0 and found.sample_values == []


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "x double")
    row = numeric_profile(df).first()
    assert (row["null_count"], row["mean"], row["median"]) == (2, 2.0, 2.0)
    assert null_profile(df).first()["null_count"] == 2
    assert distinct_counts(df).first()["unique_count"] == 2


def test_booleans_are_categories(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, True)], "k int, b boolean")
    found = profile(df, ["k"]).columns["b"]
    assert found.type_category == "categorical" and found.top_values == [("true", 2), ("false", 1)]


def test_other_types(spark):
    df = spark.sql(
        "SELECT id, array(id % 2) AS a, CAST(id AS DECIMAL(10, 2)) AS d, DATE '2024-01-01' AS day FROM range(4)"
    )
    found = profile(df, ["id"]).columns
    assert found["a"].type_category == "categorical" and found["a"].unique_count == 2
    assert found["d"].mean == 1.5 and found["day"].type_category == "datetime"


@pytest.mark.parametrize(
    "values, expected",
    [([1, 2, 2, 9, 30], 1.8975), ([5, 5, 5], 0.0), ([5, 6], None)],
)
def test_skew(spark, values, expected):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    skew = df.agg(adjusted_skew(F.col("x"))).first()[0]
    assert skew == expected or round(skew, 4) == expected


def test_short_column_counts_as_highly_skewed(spark):
    df = spark.createDataFrame([(5.0,), (6.0,)], "x double")
    assert numeric_profile(df).first()["skew_label"] == "high_skew"


def test_p_values():
    assert round(correlation_p_value(0.5, 10), 4) == 0.1411
    assert round(correlation_p_value(0.6319, 10), 4) == 0.05
    assert correlation_p_value(1.0, 10) == 0.0 and correlation_p_value(0.0, 10) == 1.0


def _interpolated(values, p):
    values = sorted(values)
    at = (len(values) - 1) * p
    low = int(at)
    if at == low or values[low] == values[low + 1]:
        return values[low]
    return values[low] + (values[low + 1] - values[low]) * (at - low)


@pytest.mark.parametrize("kind", ["hot", "two", "heavy_tail", "infinite"])
def test_narrowed_quantiles_equal_brute_force(spark, kind):
    rng = random.Random(kind)
    n = 8_000
    values = {
        "spread": lambda: rng.random() * 1e6,
        "hot": lambda: 7.0 if rng.random() < 0.34 else rng.gauss(7, 3),
        "two": lambda: float(rng.random() < 0.25),
        "constant": lambda: 3.0,
        "heavy_tail": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300),
        "infinite": lambda: float("inf") if rng.random() < 0.1 else rng.random(),
    }[kind]
    data = [values() for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in data] + [(None,)] * 100, "x double").repartition(4)
    probs = [0.0, 0.25, 0.5, 0.75, 0.99 if kind != "infinite" else 0.8, 1.0]
    # A tiny limit and a coarse sketch force several narrowing passes.
    found = exact_quantiles(df, {"x": as_double("x")}, probs, direct_rows=100, sketch_k=512)["x"]
    for p, value in zip(probs, found):
        assert value == pytest.approx(_interpolated(data, p), rel=1e-12), p


def test_quantiles_direct_and_narrowed_agree(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).cast("double").alias("x"))
    values, probs = {"x": F.col("x"), "none": F.lit(None).cast("double")}, [0.1, 0.25, 0.5]
    direct = exact_quantiles(df, values, probs)
    assert direct == exact_quantiles(df, values, probs, direct_rows=10)
    assert direct["none"] == [None, None, None]


def test_quantiles_compute_each_value_once_a_row(spark, monkeypatch):
    """Text that holds numbers is read once a pass, not for each end of each bracket."""
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).cast("string").alias("x")).repartition(2)
    plans, first = [], type(df).first

    def seen(frame):
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return first(frame)

    monkeypatch.setattr(type(df), "first", seen)
    found = exact_quantiles(df, {"x": parse_number(F.col("x"))}, [0.25, 0.5, 0.75], direct_rows=100)["x"]
    data = sorted(i * 7919 % 5003 for i in range(5000))
    assert found == pytest.approx([_interpolated(data, p) for p in (0.25, 0.5, 0.75)])
    assert len(plans) >= 4 and max(p.count("RLIKE") for p in plans) == 1


def test_leading_values_of_sparse_columns(spark):
    df = spark.range(5000).select(
        "id",
        F.when(F.col("id") % 40 == 39, F.col("id").cast("string")).alias("sparse"),
        F.when(F.col("id") < 50, "word").otherwise("12").alias("mixed"),
    )
    found = leading_values(df.repartition(7), ["id"])
    assert found["sparse"].count == 100 and found["sparse"].numbers == 100
    assert found["sparse"].samples == ["39", "79", "119", "159", "199"]
    assert found["mixed"].numbers == 50 and found["id"].samples == ["0", "1", "2", "3", "4"]


def test_ties_of_frequent_values(spark):
    df = spark.createDataFrame([(10,), (9,), (10,), (9,), (100,)], "x int")
    assert modes(df, ["x"]) == {"x": 9}
    rows = top_values(value_frequencies(df, ["x"]), 2).orderBy("position").collect()
    assert [(r["value"], r["count"]) for r in rows] == [("9", 2), ("10", 2)]


def test_bounded_distinct(spark):
    df = spark.range(10_000).select((F.col("id") % 20).alias("few"), "id", (F.col("id") % 21).alias("over"))
    assert bounded_distinct(df, ["few", "id", "over"], 20) == {"few": 20, "id": None, "over": None}


def test_flags(people):
    row = summary_flags(column_profile(people, ["row_id"])).first()
    assert row["high_null_columns"] == [] and "Age" in row["high_skew_columns"]
    low = summary_flags(column_profile(people, ["row_id"]), replace(DEFAULTS, high_null_percent=10.0)).first()
    assert low["high_null_columns"] == ["Age", "Join Date", "Name"]


def test_converted_profile(people):
    row = converted_profile(people, ["Salary"]).first()
    assert row["mean"] == 57000.0 and row["median"] == 55000.0 and row["outlier_count"] == 0


def test_merged_states_equal_the_whole(spark):
    df = spark.range(3000).select(
        (F.col("id") * 31 % 977 + 1e6).alias("x"),
        F.when(F.col("id") % 5 != 0, F.col("id") % 7).alias("y"),
        F.concat(F.lit("v"), F.col("id") % 3).alias("s"),
        (F.col("id") % 11).alias("chunk"),
    )
    states = merge.profile_states(df, ["x", "y", "s"], F.col("chunk"))
    merged = {r["column"]: r for r in merge.merge_states(states).collect()}
    whole = {r["column"]: r for r in numeric_profile(df, ["x", "y"]).collect()}
    for c in ("x", "y"):
        for name in ("mean", "min", "max", "skewness", "null_count", "skew_label"):
            assert merged[c][name] == whole[c][name]
    assert merged["x"]["std"] == round(df.agg(F.stddev_pop("x")).first()[0], 4)
    assert merged["s"]["approx_unique_count"] == 3 and merged["s"]["mean"] is None
    assert abs(merged["x"]["approx_median"] - whole["x"]["median"]) < 30
    assert merged["x"]["approx_outlier_count"] == 0


def test_few_outliers_of_merged_states(spark):
    value = F.when(F.col("id") % 2000 == 7, 1e9 + F.col("id")).otherwise(F.col("id") % 1000).cast("double")
    df = spark.range(20_000).select(value.alias("x"), (F.col("id") % 4).alias("chunk"))
    exact = numeric_profile(df, ["x"]).first()["outlier_count"]
    found = merge.merge_states(merge.profile_states(df, ["x"], F.col("chunk"))).first()["approx_outlier_count"]
    assert exact == 10 and 1 <= found and abs(found - exact) <= 0.001 * 20_000

def test_date_range_of_the_sample(spark):
    df = spark.range(300).select("id", F.expr("DATE '2024-01-01' + CAST(id AS INT)").cast("string").alias("day"))
    whole = profile(df, ["id"], duplicates=False).columns["day"]
    sample = profile(df, ["id"], duplicates=False, sample_only=True).columns["day"]
    assert whole.min_date == sample.min_date and str(whole.max_date)[:10] == "2024-10-26"
    assert str(sample.max_date)[:10] == "2024-04-09" and sample.type_category == "should_be_datetime"


def test_merged_categories(spark):
    df = spark.sql("SELECT 1 AS n, 'a' AS s, true AS b, DATE '2024-01-01' AS d")
    found = {r["column"]: r["type_category"] for r in merge.merge_states(merge.profile_states(df)).collect()}
    assert found == {"n": "numeric", "s": "categorical", "b": "categorical", "d": "other"}


def test_first_values_of_many_sparse_columns_take_one_pass(spark):
    """Keys of several kinds, with NULL and NaN, against a sort; jobs do not grow with the columns."""
    n, width = 3_000, 40
    cells = [F.when(F.hash("id", F.lit(c)) % 100 == 0, F.concat(F.lit(f"v{c}-"), "id")).alias(f"c{c}") for c in range(width)]
    keys = [
        F.when(F.col("id") % 5 > 0, (F.col("id") * 7919 % 11).cast("double")).alias("d"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("é"), (F.col("id") % 13).cast("string"))).alias("t"),
        F.col("id"),
    ]
    df = spark.range(n).select(*keys, *cells).withColumn("d", F.when(F.col("d") == 3, float("nan")).otherwise(F.col("d")))
    df = df.repartition(9)
    order = ["d", "t", "id"]
    found = leading_values(df, order, [f"c{c}" for c in range(width)], limit=7, keep=7)
    rows = df.orderBy(*order).collect()
    for c in range(width):
        want = [r[f"c{c}"] for r in rows if r[f"c{c}"] is not None][:7]
        assert found[f"c{c}"].samples == want

    def jobs(columns, group):
        spark.sparkContext.setJobGroup(group, group)
        leading_values(df, order, columns, limit=7, keep=7)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few = jobs(["c0", "c1"], "few columns")
    assert jobs([f"c{c}" for c in range(width)], "many columns") == few
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_first_values_by_nested_keys(spark):
    df = spark.range(500).select(F.array(F.col("id") % 7, "id").alias("a"), F.when(F.col("id") % 9 == 0, F.col("id")).alias("x"))
    got = first_values(df.repartition(6), ["a"], {"x": 4}).orderBy("order").collect()
    assert [int(r["text"]) for r in got] == sorted(range(0, 500, 9), key=lambda i: (i % 7, i))[:4]


@pytest.fixture(scope="module")
def values(spark):
    def text(i):
        return None if i % 10 == 0 else "é" * (i % 3) if i % 10 < 5 else f"value {i * 7919 % 1_009}"

    rows = [(text(i), f"key {i:05d}", f"pair {i // 2 * 7919 % 10_007}", i % 2 == 0, i % 7, float(i % 5), None) for i in range(2_000)]
    df = spark.createDataFrame(rows, "t string, unique string, pairs string, b boolean, n int, x double, none string")
    day = F.date_add(F.lit("1969-12-30").cast("date"), F.col("n"))
    return df.withColumns({"d": day, "m": F.col("n").cast("decimal(20,2)"), "a": F.array("n")}).repartition(7)


@pytest.mark.parametrize("ties", [1, 3, 200])
def test_common_values_equal_whole_values(values, monkeypatch, ties):
    monkeypatch.setattr(counts, "TIES", ties)
    found = counts.common_values(values, values.columns, 3)
    for name in values.columns:
        whole = values.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("count"))
        rows = whole.select(name, F.col(name).cast("string").alias("text"), "count").collect()
        typed = (lambda r: r["text"]) if name == "a" else lambda r: r[name]
        best = sorted(rows, key=lambda r: (-r["count"], typed(r)))[:3]
        assert found[name].unique == len(rows)
        assert [(text, n) for _, text, n in found[name].top] == [(r["text"], r["count"]) for r in best]


def test_texts_that_share_a_hash_are_counted_apart(values, monkeypatch):
    hashes = counts._hashes
    monkeypatch.setattr(counts, "_hashes", lambda name: (hashes(name)[0] % 5, hashes(name)[1]))
    found = counts.common_values(values, ["t", "unique", "b"], 2)
    monkeypatch.undo()
    assert found == counts.common_values(values, ["t", "unique", "b"], 2)


def test_the_shuffle_of_counts_holds_no_text(values):
    plan = counts._hashed_frequencies(values, ["t", "unique", "pairs"])._jdf.queryExecution().optimizedPlan().toString()
    assert [f.name for f in counts._hashed_frequencies(values, ["t"]).schema.fields if f.dataType == T.StringType()] == ["text"]
    assert "xxhash64" in plan
    assert counts._hashed_frequencies(values, ["t", "unique"]).filter("text is not null").isEmpty()
