"""Ordered operators against plain windows, on a table where one group holds most rows."""

from __future__ import annotations

import bisect

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators import joins, ordered
from tests.conftest import same_rows

UPTO = (W.unboundedPreceding, W.currentRow)


@pytest.fixture(scope="module")
def rows(spark):
    key = F.xxhash64("id")
    return spark.range(1500).select(
        (F.col("id") * 613 % 1500).alias("id"),
        # ties in the time, one hot user, a few users without any value
        F.timestamp_micros(F.pmod(key, F.lit(300)) * 1_000_000).cast("timestamp_ntz").alias("ts"),
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 40)).alias("user"),
        F.when(F.pmod(key, F.lit(5)) == 0, F.pmod(key, F.lit(50))).alias("v"),
    ).cache()


GROUPS = [(), ("user",)]
SIZES = [10_000, 200, 1]


def _window(group):
    return W.partitionBy(*group).orderBy("ts", "id")


@pytest.mark.parametrize("group", GROUPS)
@pytest.mark.parametrize("size", SIZES)
def test_carried_operators(rows, group, size):
    w, order = _window(group), ["ts", "id"]
    options = {"partition_by": group, "rows_per_range": size}
    filled = F.last("v", ignorenulls=True).over(w.rowsBetween(*UPTO))
    assert same_rows(ordered.forward_fill(rows, "v", order, **options), rows.withColumn("v", filled))
    total = F.when(F.col("v").isNotNull(), F.sum("v").over(w.rowsBetween(*UPTO)))
    assert same_rows(ordered.running_sum(rows, "v", order, name="t", **options), rows.withColumn("t", total))
    number = F.row_number().over(w).cast("bigint")
    assert same_rows(ordered.row_numbers(rows, order, name="n", **options), rows.withColumn("n", number))
    mean = F.avg("v").over(w.rowsBetween(*UPTO))
    assert same_rows(ordered.running_mean(rows, "v", order, name="m", **options), rows.withColumn("m", mean))


@pytest.mark.parametrize("group", GROUPS)
@pytest.mark.parametrize("size", [10_000, 3])
def test_neighbours(rows, group, size):
    w, order = _window(group), ["ts", "id"]
    options = {"partition_by": group, "rows_per_range": size}
    back = F.lag("v", 4).over(w)
    assert same_rows(ordered.shift(rows, "v", order, 4, name="s", **options), rows.withColumn("s", back))
    full = rows.withColumn("x", F.coalesce("v", F.lit(1)).cast("double"))
    frame = w.rowsBetween(-4, 0)
    mean = F.when(F.count("x").over(frame) == 5, F.avg("x").over(frame))
    assert same_rows(ordered.rolling_mean(full, "x", order, 5, name="m", **options), full.withColumn("m", mean))
    change = ordered.changes(full, "x", order, **options).select("id", "x_diff")
    assert same_rows(change, full.select("id", (F.col("x") - F.lag("x").over(w)).alias("x_diff")))


@pytest.mark.parametrize("group", GROUPS)
@pytest.mark.parametrize("size", [10_000, 7])
def test_ranks(rows, group, size):
    w = W.partitionBy(*group).orderBy("v")
    some = rows.filter("v is not null")
    for method, expected in [
        ("min", F.rank().over(w).cast("bigint")),
        ("dense", F.dense_rank().over(w).cast("bigint")),
        ("average", F.rank().over(w) + (F.count("*").over(W.partitionBy(*group, "v")) - 1) / 2.0),
    ]:
        found = ordered.rank_values(rows, "v", group, "r", method, rows_per_range=size)
        assert found.filter("v is null and r is not null").isEmpty()
        assert same_rows(found.filter("v is not null"), some.withColumn("r", expected))


def test_ranks_of_many_values(rows, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(joins, "HOT_KEYS", 3)
    expected = rows.filter("v is not null").withColumn(
        "r", F.rank().over(W.partitionBy("user").orderBy("v")).cast("bigint")
    )
    found = ordered.rank_values(rows, "v", ["user"], "r")
    assert found.count() == rows.count() and same_rows(found.filter("v is not null"), expected)


def test_descending_nulls_and_null_groups(spark):
    rows = [(1, None, 1), (2, None, None), (3, "a", None), (4, "a", 5), (5, "a", None), (6, None, None)]
    df = spark.createDataFrame(rows, "k int, g string, v int")
    found = ordered.forward_fill(df, "v", ["k"], ["g"], rows_per_range=1)
    assert [r["v"] for r in found.orderBy("k").collect()] == [1, 1, None, 5, 5, 1]


def test_fill_of_several_columns(spark):
    df = spark.createDataFrame([(1, 1, None), (2, None, "b"), (3, None, None)], "k int, a int, b string")
    found = ordered.forward_fill(df, ["a", "b"], ["k"], rows_per_range=1).orderBy("k").collect()
    assert [(r["a"], r["b"]) for r in found] == [(1, None), (1, "b"), (1, "b")]


@pytest.mark.parametrize("size", [10_000, 13])
def test_asof_join(rows, size):
    left = rows.filter("v is null").select("id", "ts", "user")
    right = rows.filter("v is not null").select("ts", "user", "v")
    found = ordered.asof_join(left, right, "ts", ["user"], ["v"], "id", rows_per_range=size)
    latest = right.select(F.col("ts").alias("t"), F.col("user").alias("u"), "v")
    pairs = left.join(latest, (F.col("u") == F.col("user")) & (F.col("t") <= F.col("ts")), "left")
    expected = pairs.groupBy("id", "ts", "user").agg(F.max(F.struct("t", "v"))["v"].alias("v"))
    assert same_rows(found, expected)


def test_no_range_sees_all_rows(rows):
    cut = ordered.Ranges(rows, ["ts", "id"], ["user"], rows_per_range=100)
    sizes = cut.df.groupBy(cut.bucket).count().collect()
    assert len(sizes) >= 12 and max(r["count"] for r in sizes) < 500


@pytest.mark.parametrize("size", [400, 20, 3])
def test_ranges_are_found_by_halving(rows, size):
    """A row meets some log2 of the boundaries, not each of them or the root of their number."""
    some = rows.withColumn("user", F.when(F.col("id") % 7 > 0, F.col("user")))
    cut = ordered.Ranges(some, ["ts", "id"], ["user"], rows_per_range=size)
    comparable = lambda key: tuple((v is not None, v) if v is not None else (False,) for v in key)
    bounds = [comparable(b) for b in cut.bounds]
    assert len(bounds) > 2
    for r in cut.df.collect():
        assert r[cut.bucket] == bisect.bisect_right(bounds, comparable((r["user"], r["ts"], r["id"])))
    steps = ",".join(str(1 << b) for b in reversed(range(len(bounds).bit_length())))
    plan = cut.df._jdf.queryExecution().optimizedPlan().toString()
    assert f"aggregate([{steps}]" in plan and "filter(" not in plan
    assert not cut.df.schema[cut.bucket].nullable
