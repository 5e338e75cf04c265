"""Correlations of many columns against a plain computation over pairwise complete rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import correlations as module
from plumbline.functions.columns import as_double
from plumbline.operators import dashboard, target


def wide_table(spark, columns, rows=400):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(rows, columns)) * 10.0 ** rng.integers(-3, 8, columns) + rng.integers(-5, 5, columns) * 1e4
    data[:, 1] = data[:, 0] * -2 + 1
    data[rng.random(data.shape) < 0.2] = np.nan
    data[:, 2] = 7.25  # no variance
    data[:, 3] = 1e9 + np.arange(rows) % 2 * 1e-3  # next to none
    data[5, 4] = np.inf
    data[:, 5] = np.where(np.isnan(data[:, 6]), data[:, 5], 3.0)  # constant where the next one is known
    data[:, 7] = np.nan
    data[:, 8] *= 1e290
    names = [f"c{i}" for i in range(columns)]
    lists = [[None if np.isnan(v) else float(v) for v in row] for row in data]
    schema = ", ".join(f"{c} double" for c in names)
    return data, spark.createDataFrame(lists, schema).repartition(5)


def plain(x, y):
    both = ~np.isnan(x) & ~np.isnan(y)
    x, y = x[both].astype(np.longdouble), y[both].astype(np.longdouble)
    if len(x) < 2 or np.isinf(x).any() or np.isinf(y).any() or x.min() == x.max() or y.min() == y.max():
        return len(x), None
    x, y = x - x.mean(), y - y.mean()
    return len(x), float((x * y).sum() / np.sqrt((x * x).sum()) / np.sqrt((y * y).sum()))


def test_three_hundred_columns_in_a_fixed_number_of_jobs(spark):
    data, df = wide_table(spark, 300)
    data[:, 3], df = data[:, 0], df.withColumn("c3", F.col("c0"))
    direct, calls = module._direct, []
    module._direct = lambda d, v, pairs: calls.append(len(pairs)) or direct(d, v, pairs)
    try:
        found = {(r["x"], r["y"]): r["r"] for r in dashboard.correlation_matrix(df).collect()}
    finally:
        module._direct = direct
    assert len(found) == 300 * 300
    assert sum(calls) == 0
    for i in range(300):
        for j in [*range(9), i, (i * 7 + 11) % 300]:
            _, r = plain(data[:, i], data[:, j])
            got = found[f"c{i}", f"c{j}"]
            assert got == (None if r is None else pytest.approx(r, abs=1e-6)), (i, j)
            assert got == found[f"c{j}", f"c{i}"]


def test_blocks_equal_the_aggregate(spark, monkeypatch):
    data, df = wide_table(spark, 12)
    values = {c: as_double(c) for c in df.columns if c != "c8"}
    direct = module.correlations(df, values)
    monkeypatch.setattr(module, "DIRECT_PAIRS", 1)
    monkeypatch.setattr(module, "PAIRS_IN_STATE", 40)  # several passes
    monkeypatch.setattr(module, "CELLS", 60)  # several cuts of a batch
    blocks = module.correlations(df, values)
    assert [b[:3] for b in blocks] == [d[:3] for d in direct]
    for b, d in zip(blocks, direct):
        n, r = plain(data[:, int(b[0][1:])], data[:, int(b[1][1:])])
        assert b[2] == n
        assert b[3] == (None if r is None else pytest.approx(r, abs=1e-9))
        assert d[3] == (None if r is None else pytest.approx(r, abs=1e-3 if "c3" in b else 1e-9))


def test_one_target_against_many_columns(spark, monkeypatch):
    data, df = wide_table(spark, 60)
    want = {r["column"]: r for r in target.feature_correlations(df, "c0").collect()}
    monkeypatch.setattr(module, "DIRECT_PAIRS", 3)
    got = {r["column"]: r for r in target.feature_correlations(df, "c0").collect()}
    assert got == want and "c0" not in got and got["c1"]["correlation"] == -1.0


def test_tables_without_rows_or_values(spark, monkeypatch):
    monkeypatch.setattr(module, "DIRECT_PAIRS", 0)
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    for table in (df, df.where(F.lit(False))):
        found = {r["r"] for r in dashboard.correlation_matrix(table.select("a", "b")).collect() if r["x"] == "a"}
        assert found == {None}
    empty = module.correlations(df.where("b < 0"), {c: as_double(c) for c in "ab"})
    assert empty == [("a", "a", 0, None), ("a", "b", 0, None), ("b", "b", 0, None)]
