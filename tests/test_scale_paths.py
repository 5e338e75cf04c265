"""Results that must not depend on how a table is cut, and rows of awkward types."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.functions.counts import modes
from plumbline.operators import dashboard, ordered, rows
from plumbline.operators.profile import table_profile
from plumbline.plans.run import clean


@pytest.mark.parametrize("periods", [-3, -1, 2])
@pytest.mark.parametrize("group", [[], ["g"]])
def test_shift_in_both_directions(spark, periods, group):
    df = spark.range(11).select("id", (F.col("id") % 2).alias("g"))
    got = {r["id"]: r["id_shift"] for r in ordered.shift(df, "id", ["id"], periods, group, rows_per_range=3).collect()}
    step = periods * (2 if group else 1)
    assert got == {i: i - step if 0 <= i - step <= 10 else None for i in range(11)}


def test_reach_is_not_negative(spark):
    with pytest.raises(ValueError):
        ordered.neighbours(spark.range(3), ["id"], {}, -1)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.sql("""SELECT * FROM VALUES
      (CAST(9.00 AS DECIMAL(6, 2)), map('a', 1, 'b', 2), 'k1', 1.0D), (10.00, map('b', 2, 'a', 1), 'k2', double('inf')),
      (10.00, map('a', 1), NULL, 2.0D), (9.00, map('b', 2, 'a', 1), 'k2', 3.0D) AS t(d, m, k, v)""")


def test_decimal_ties_take_the_smaller_number(odd):
    assert modes(odd, ["d"]) == {"d": "9.00"}


def test_rows_with_maps_are_compared(odd):
    only = odd.select("m")
    assert rows.count_duplicates(only) == rows.count_duplicates(only, 0) == 2
    assert rows.drop_duplicates(only).count() == rows.drop_duplicates(only, 0).count() == 2
    assert table_profile(only).first()["duplicate_rows"] == 2


def test_rows_with_maps_inside_other_values(spark):
    df = spark.sql("""SELECT * FROM VALUES
      (named_struct('m`x', map('a', map('k', -0.0D, 'l', 1D))), array(map(1, 'x', 2, 'y')), 1),
      (named_struct('m`x', map('a', map('l', 1D, 'k', 0.0D))), array(map(2, 'y', 1, 'x')), 1),
      (named_struct('m`x', map('a', map('l', 2D, 'k', 0.0D))), array(map(2, 'y', 1, 'x')), 1),
      (NULL, array(NULL, map(2, 'y')), 2), (NULL, array(NULL, map(2, 'y')), 2),
      (NULL, array(map(2, 'y'), NULL), 2), (NULL, NULL, 2) AS t(s, a, `n.n`)""")
    assert rows.count_duplicates(df) == rows.count_duplicates(df, 0) == 2
    for limit in (100, 0):
        kept = rows.drop_duplicates(df, limit)
        assert kept.count() == 5 and kept.dtypes == df.dtypes
    assert table_profile(df).first()["duplicate_rows"] == 2


def test_infinite_values_are_in_no_bin(odd):
    bins = dashboard.histogram(odd, ["v"], 2).orderBy("bin").collect()
    assert [(r["low"], r["high"], r["count"]) for r in bins] == [(1.0, 2.0, 1), (2.0, 3.0, 2)]


def test_rows_without_key_have_a_bucket_of_their_own(odd):
    got = {(r["bucket"], r["column"]): r["null_share"] for r in dashboard.nullity_matrix(odd.select("k", "d"), "k", 2).collect()}
    assert got[(None, "k")] == 1.0 and got[(0, "k")] == 0.0
    numbers = odd.select(F.when(F.col("v") > 1, F.col("v")).alias("n"))
    assert {r["bucket"] for r in dashboard.nullity_matrix(numbers.where("n is null or n < 9"), "n", 2).collect()} == {None, 0, 1}


def test_whole_run_with_a_sparse_text_key(spark):
    df = spark.createDataFrame(
        [(f"k{i:03d}" if i > 70 else None, float(i), i % 3) for i in range(100)], "key string, v double, c int"
    )
    result = clean(df, ["key"], target="v")
    assert "key" in result.cleaned.columns and result.cleaned.count() == 100
    assert {"nullity_matrix", "dist_v", "box_v"} <= set(result.charts)
