from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions.group_quantiles import group_quantiles
from plumbline.operators import dashboard, features, query, retrieval, target
from plumbline.operators.profile import profile
from tests.conftest import column, same_rows


# Target


def test_task_types(spark):
    df = spark.range(100).select("id", (F.col("id") % 10).alias("few"), F.col("id").cast("string").alias("s"))
    assert [target.task_type(df, c) for c in ("id", "few", "s")] == ["regression", "classification", "classification"]


@pytest.mark.parametrize(
    "sizes, label",
    [
        ([5], "single_class"),
        ([10, 8], "balanced"),
        ([10, 4], "slightly_imbalanced"),
        ([10, 1], "imbalanced"),
        ([30, 1], "severely_imbalanced"),
    ],
)
def test_class_balance(spark, sizes, label):
    rows = [(f"c{i}",) for i, n in enumerate(sizes) for _ in range(n)] + [(None,)]
    df = spark.createDataFrame(rows, "y string")
    assert target.class_balance(df, "y").first()["class_balance"] == label


def test_class_weights(spark):
    df = spark.createDataFrame([("no",)] * 6 + [("yes",)] * 2, "y string")
    rows = {r["class"]: r for r in target.class_weights(df, "y").collect()}
    assert rows["yes"]["weight"] == 2.0 and rows["no"]["weight"] == pytest.approx(2 / 3)
    assert rows["yes"]["positive_ratio"] == 3.0
    weighted = target.weighted_rows(df, "y")
    assert weighted.agg(F.sum("class_weight")).first()[0] == pytest.approx(8.0)


def test_correlations(spark):
    rows = [(float(i), float(-2 * i), float(i % 3), None if i > 7 else 1.0 * i, i % 2 == 0, "ab"[i % 2]) for i in range(20)]
    df = spark.createDataFrame(rows, "y double, down double, noise double, short double, flag boolean, two string")
    found = target.feature_correlations(df, "y").collect()
    assert found[0]["column"] == "down" and found[0]["correlation"] == -1.0 and found[0]["p_value"] == 0.0
    assert "short" not in [r["column"] for r in found] and "flag" in [r["column"] for r in found]
    xs, ys = np.array([r[2] for r in rows]), np.array([r[0] for r in rows])
    noise = next(r for r in found if r["column"] == "noise")
    assert noise["correlation"] == pytest.approx(round(np.corrcoef(xs, ys)[0, 1], 4)) and not noise["significant"]
    assert target.feature_correlations(df, "two").first()["column"] == "flag"
    three = df.withColumn("z", F.concat(F.lit("k"), F.col("noise")))
    assert target.feature_correlations(three, "z").isEmpty()


# Features


def test_bins(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.0, 2.0, 2.5, 4.0, 10.0, None])], "k int, x double")
    assert column(features.add_bins(df, "x"), "x_bin", "k") == [0, 0, 1, 1, 4, None]


def test_encodings(spark):
    df = spark.createDataFrame([(0, "b", 1.0), (1, "a", 3.0), (2, "b", 5.0), (3, None, 7.0)], "k int, c string, y double")
    hot = features.add_onehot(df, "c")
    assert hot.columns == ["k", "y", "c_b"] and column(hot, "c_b", "k") == [1, 0, 1, 0]
    assert column(features.add_label(df, "c"), "c_enc", "k") == [1, 0, 1, None]
    assert column(features.add_target_mean(df, "c", "y"), "c_target_mean", "k") == [3.0, 3.0, 3.0, None]
    with pytest.raises(ValueError):
        features.add_onehot(spark.range(60).select(F.col("id").cast("string").alias("c")), "c")


def test_suggestions(spark):
    df = spark.range(200).select(
        F.pow(F.lit(1.1), F.col("id")).alias("steep"),
        (F.col("id") % 5).alias("small"),
        F.when(F.col("id") % 2 == 0, -100.0).otherwise(99.0).alias("around_zero"),
        (F.col("id") % 4).cast("string").alias("few"),
        (F.col("id") % 40).cast("string").alias("some"),
        F.col("id").cast("string").alias("many"),
        F.col("id").alias("goal"),
    )
    found = {(r["column"], r["suggestion"]) for r in features.suggest_features(df, "goal").collect()}
    assert found == {
        ("steep", features.LOG),
        ("steep", features.BIN),
        ("around_zero", features.STANDARDIZE),
        ("few", features.ONEHOT),
        ("some", features.LABEL),
        ("many", features.DROP),
    }
    made = features.apply_suggestions(df, features.suggest_features(df, "goal"))
    assert {"steep_log", "steep_bin", "around_zero_scaled", "few_1", "some_enc"} <= set(made.columns)
    assert "many" not in made.columns and "few" not in made.columns


# Dashboard


def test_histogram_and_density(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("c"))
    counts = {(r["column"], r["bin"]): r["count"] for r in dashboard.histogram(df, nbins=10).collect()}
    assert counts[("x", 0)] == 10 and counts[("x", 9)] == 11 and counts[("c", 0)] == 101
    curve = dashboard.density(df, "x").collect()
    area = sum(r["density"] for r in curve) * (curve[1]["x"] - curve[0]["x"])
    assert 0.85 < area < 1.0
    assert dashboard.density(df.limit(9), "x").isEmpty()


def test_correlation_matrix_skips_nulls(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (2.0, None, "b"), (3.0, 6.0, "c"), (4.0, 8.0, "d")], "x double, y double, s string")
    found = {(r["x"], r["y"]): r["r"] for r in dashboard.correlation_matrix(df).collect()}
    assert found[("x", "y")] == pytest.approx(1.0) and len(found) == 4
    assert dashboard.correlation_matrix(df.select("x")).isEmpty()


def test_box_and_nullity(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([25.0, 22.0, 28.0, 24.0, 26.0, 300.0, None])], "k int, x double")
    row = dashboard.box_stats(df, ["x"]).first()
    assert (row["q1"], row["q3"], row["lower_whisker"], row["upper_whisker"], row["outlier_count"]) == (24.25, 27.5, 22.0, 28.0, 1)
    shares = {(r["bucket"], r["column"]): r["null_share"] for r in dashboard.nullity_matrix(df, "k", 2).collect()}
    assert shares[(1, "x")] == 0.25 and shares[(0, "x")] == 0.0


def test_charts(spark, people):
    charts = dashboard.dashboard(people, profile(people, ["row_id"]), "row_id")
    assert set(charts) == {"nullity_matrix", "correlation_heatmap", "dist_row_id", "box_row_id", "dist_Age", "box_Age", "bar_Name"}
    assert charts["bar_Name"].first()["value"] == "Alice"


# Retrieval


def test_chunks(spark):
    text = "".join(chr(97 + i % 26) for i in range(1098)) + "é😀"
    df = spark.createDataFrame([(1, text), (2, ""), (3, "x" * 450), (4, "a\nb")], "doc_id bigint, text string")
    found = retrieval.chunks(df).orderBy("doc_id", "chunk_id").collect()
    assert [(r["doc_id"], r["start"]) for r in found] == [(1, 0), (1, 450), (1, 900), (3, 0), (4, 0)]
    assert [r["text"] for r in found[:3]] == [text[s : s + 500] for s in (0, 450, 900)]
    assert found[4]["text"] == "a\nb"


def test_top_matches_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(400, 8))
    vectors[100:230] = vectors[100]  # a third of the corpus is one vector
    vectors[7] = 0.0
    asked = np.vstack([vectors[100], rng.normal(size=(4, 8))])
    corpus = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id bigint, vector array<double>")
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(asked)], "query_id bigint, vector array<double>")
    found = retrieval.top_matches(corpus.repartition(5), queries, ["id"], k=4, min_score=0.5, block=2)
    units = vectors / np.where(np.linalg.norm(vectors, axis=1, keepdims=True) == 0, 1, np.linalg.norm(vectors, axis=1, keepdims=True))
    scores = (asked / np.linalg.norm(asked, axis=1, keepdims=True)) @ units.T
    expected = set()
    for q in range(len(asked)):
        best = sorted(range(400), key=lambda i: (-round(scores[q, i], 12), i))[:4]
        expected |= {(q, n + 1, i) for n, i in enumerate(best) if scores[q, i] > 0.5}
    assert {(r["query_id"], r["rank"], r["id"]) for r in found.collect()} == expected


def test_context(spark):
    docs = spark.createDataFrame(
        [(1, "column salary: description, meaning, valid range 1000 to 90000"), (2, "colour of the car"), (3, "   ")],
        "doc_id bigint, text string",
    )
    corpus = retrieval.chunks(docs)
    vectors = retrieval.TextVectors(64).fit(corpus)
    assert vectors.transform(corpus).count() == 2
    norm = vectors.transform(corpus).select(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).first()[0]
    assert norm == pytest.approx(1.0, abs=1e-5)
    found = retrieval.context_for_columns(spark, ["salary"], corpus, vectors=vectors)
    assert [r["query_id"] for r in found.collect()] == ["salary"]
    assert found.first()["context"].startswith("column salary")


# Questions


@pytest.fixture(scope="module")
def riders(spark):
    rows = [("a", 70.0, 1), ("b", 60.0, 0), ("a", 20.0, 1), (None, 61.0, 0), ("b", None, None)]
    return spark.createDataFrame(rows, "g string, age double, won int")


def test_questions(riders):
    assert [tuple(r) for r in query.group_mean(riders, "g", "age").collect()] == [("a", 45.0), ("b", 60.0)]
    assert query.filter_rows(riders, "age", ">", 60).count() == 2
    assert query.filter_rows(riders, "age", ">=", 60).count() == 3
    assert query.row_count(riders).first()[0] == 5
    assert [tuple(r) for r in query.value_counts(riders, "g").collect()] == [("a", 2), ("b", 2)]
    assert query.percentage(riders, F.col("won") == 1).first()[0] == 50.0
    assert {r["column"]: r["null_count"] for r in query.null_counts(riders).collect()} == {"g": 1, "age": 1, "won": 1}
    series = query.chart_series(query.value_counts(riders, "g"), "bar")
    assert series.dtypes == [("category", "string"), ("value", "double")]
    assert query.chart_series(riders, "none") is None and query.chart_series(riders.select("g"), "bar") is None
    assert query.chart_series(riders, "scatter").columns == ["g", "age"]


def test_structured_queries(riders):
    spec = {"where": [("age", "is_null", False)], "group_by": ["g"], "aggs": {"n": ("count", "*")}, "having": [("n", ">", 1)]}
    assert [tuple(r) for r in query.run_query(riders, spec).collect()] == [("a", 2)]
    assert query.run_query(riders, {"order_by": ["-age"], "limit": 1, "select": ["age"]}).first()[0] == 70.0
    for bad in ({"code": "x"}, {"where": [("age", "os.system", 1)]}, {"aggs": {"n": ("eval", "age")}}):
        with pytest.raises(ValueError):
            query.run_query(riders, bad)


def test_sql_is_read_only(spark, riders):
    assert query.run_sql(riders, "SELECT count(*) AS n FROM {df}").first()["n"] == 5
    riders.createOrReplaceTempView("riders_view")
    for text in ("DROP VIEW riders_view /* {df} */", "CREATE TABLE t AS SELECT * FROM {df}", "SET a=b -- {df}"):
        with pytest.raises(Exception):
            query.run_sql(riders, text)
    assert spark.catalog.tableExists("riders_view")


def test_sql_reads_the_given_table_only(spark, riders):
    riders.createOrReplaceTempView("other_view")
    spark.udf.register("shout", lambda x: x)
    for text in (
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home') AS x FROM {df}",
        "SELECT `java_method`('java.lang.System', 'getProperty', 'user.home') AS x FROM {df}",
        "SELECT a.g FROM {df} AS a, other_view AS b",
        "SELECT g, (SELECT max(age) FROM other_view) AS m FROM {df}",
        "SELECT " + ", ".join(f"won + {i} AS w{i}" for i in range(40)) + ", (SELECT max(age) FROM other_view) AS m FROM {df}",
        "SELECT g FROM {df} WHERE age IN (SELECT age FROM parquet.`/tmp/somewhere`)",
        "SELECT s.age, 'CTE [other_view]' AS a FROM other_view s CROSS JOIN {df} d",
        "WITH x AS (SELECT * FROM csv.`/tmp/somewhere`) SELECT x.* FROM x CROSS JOIN {df}",
        "WITH x AS (SELECT * FROM other_view) SELECT x.age FROM x CROSS JOIN {df}",
        "SELECT g FROM {df} WHERE EXISTS (SELECT 1 FROM spark_catalog.default.t)",
        "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home') AS x FROM {df}",
        "SELECT shout(g) AS g FROM {df}",
        "SELECT g, t.age FROM {df}, LATERAL (SELECT age FROM other_view) t",
    ):
        with pytest.raises(ValueError):
            query.run_sql(riders, text)
    text = "WITH few AS (SELECT g, age FROM {df} WHERE won = 1) SELECT max(few.age) AS m FROM few JOIN {df} USING (g)"
    assert query.run_sql(riders, text).columns == ["m"]
    for text in (
        "SELECT 'reflect' AS word, 'parquet.`x`' AS path, upper(g) AS g FROM {df}",
        "SELECT g, (SELECT max(age) FROM {df}) AS m, rank() OVER (PARTITION BY g ORDER BY age) AS r FROM {df} d",
        "SELECT v.x, d.g FROM {df} d JOIN VALUES (1), (2) AS v(x) ON d.won = v.x CROSS JOIN range(2)",
        "SELECT explode(split(g, '')) AS letter, transform(array(age), a -> a + 1) AS more FROM {df}",
        "SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY age) AS m, json_object_keys('{}') AS k FROM {df}",
    ):
        query.run_sql(riders, text).collect()
    assert not any(t.name.startswith("given_") for t in spark.catalog.listTables())


def test_computed_columns(spark):
    df = spark.createDataFrame(
        [(1, 7.5, " Ab,c ", "2024-02-28", '{"k": "4"}'), (2, None, None, None, None), (3, -1.0, "x", "bad", "{")],
        "id bigint, v double, s string, d string, j string",
    )
    col = lambda n: ("col", n)
    day = ("cast", col("d"), "date")
    trees = {
        "net": ("round", ("mul", col("v"), ("sub", 1, 0.1)), 2),
        "none": ("div", col("v"), 0),
        "sign": ("case", (("gt", col("v"), 0), "plus"), (("is_null", col("v")), "none"), "minus"),
        "word": ("upper", ("part", ("trim", col("s")), ",", 0)),
        "year": ("year", day),
        "next": ("cast", ("add_days", day, 2), "string"),
        "k": ("cast", ("json", col("j"), "$.k"), "bigint"),
        "differs": ("ne", col("s"), "x"),
    }
    got = [tuple(r) for r in query.run_query(df, {"compute": trees, "select": list(trees), "order_by": []}).collect()]
    assert got == [
        (6.75, None, "plus", "AB", 2024, "2024-03-01", 4, True),
        (None, None, "none", None, None, None, None, True),
        (-0.9, None, "minus", "X", None, None, None, False),
    ]
    for bad in (("run", 1), ("cast", col("v"), "binary"), ("truncate", day, "eon"), ("upper",), (), ("case", 1), (["col"], "v")):
        with pytest.raises(ValueError):
            query.run_query(df, {"compute": {"x": bad}})


def test_groups_pivots_and_sets(spark, riders):
    spec = {"group_by": ["g"], "aggs": {"m": ("median", "age"), "q": ("quantile", "age", 0.25), "n": ("count", "*"), "w": ("mode", "won")}}
    spec["aggs"] |= {"young": ("first", "won", ["age"]), "old": ("last", "won", ["age"])}
    table = riders.toPandas()
    found = {r["g"]: r for r in query.run_query(riders, spec).collect()}
    for g, part in table.groupby("g", dropna=False):
        row = found[None if g != g else g]
        assert row["n"] == len(part) and row["m"] == part["age"].median() and row["q"] == part["age"].quantile(0.25)
        modes = part["won"].mode()
        assert row["w"] == (modes[0] if len(modes) else None)
        known = part.dropna(subset=["won"]).sort_values("age")["won"]
        assert (row["young"], row["old"]) == ((known.iloc[0], known.iloc[-1]) if len(known) else (None, None))
    total = query.run_query(riders, {"aggs": {"m": ("median", "age"), "n": ("count", "*"), "w": ("mode", "won")}}).collect()
    assert len(total) == 1 and total[0]["m"] == table["age"].median()
    wide = query.run_query(riders, {"group_by": ["g"], "pivot": ("won", [0, 1]), "aggs": {"n": ("count", "*")}})
    assert wide.columns == ["g", "0", "1"]
    both = {"where": [("won", "==", 1)]}
    assert query.run_query(riders, {"semi": (both, {"g": "g"})}).count() + query.run_query(
        riders, {"anti": (both, {"g": "g"})}
    ).count() == riders.count()
    assert query.run_query(riders, {"union": {}}).count() == 2 * riders.count()
    assert query.run_query(riders, {"except": {"where": [("age", "<", 61)]}}).count() == riders.filter("not coalesce(age < 61, false)").distinct().count()
    for bad in ({"group_by": ["g"], "grouping": "sets", "aggs": {}}, {"from": "other"}, {"group_by": ["g"], "pivot": ("won", [1]), "aggs": {}}):
        with pytest.raises(ValueError):
            query.run_query(riders, bad)


@pytest.mark.parametrize("limit", [10, 100, 10_000])
def test_group_quantiles_equal_whole_groups(spark, limit):
    """One group holds most rows, one hot value a third of it; keys and values may be missing."""
    g = F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, F.concat(F.lit("g"), (F.col("id") % 7).cast("string")))
    v = F.when(F.col("id") % 3 == 0, 5.0).when(F.col("id") % 11 > 0, F.hash("id") % 1_009 / 7)
    df = spark.range(6_000).select(g.alias("g"), F.when(F.col("id") % 70 != 8, v).alias("v"))
    probs = [0.0, 0.1, 0.5, 0.99, 1.0]
    found = {r[0]: r[1:] for r in group_quantiles(df, ["g"], F.col("v"), probs, limit).collect()}
    table = df.toPandas()
    for key, part in table.groupby("g", dropna=False):
        want = part["v"].dropna()
        got = found.pop(None if key != key else key)
        assert np.allclose(got, np.quantile(want, probs)) if len(want) else got == (None,) * 5
    assert not found
    whole = group_quantiles(df, [], F.col("v"), [0.5], limit).collect()
    assert len(whole) == 1 and whole[0][0] == table["v"].median()
    assert group_quantiles(df.filter("1 = 0"), ["g"], F.col("v"), [0.5], limit).collect() == []


def test_nested_conditions(riders):
    either = ("any", [("age", ">", 65), ("all", [("g", "==", "b"), ("won", "is_null", True)])])
    assert query.run_query(riders, {"where": [either]}).count() == 2
    assert query.run_query(riders, {"where": [("not", [("g", "==", "a")]), ("age", "<", 61)]}).count() == 1
    for bad in (("some", []), ("any", [("age", "like", 1)])):
        with pytest.raises(ValueError):
            query.condition([bad])


def test_describe(spark, riders):
    found = {r["column"]: r for r in query.describe(riders).collect()}
    assert tuple(found["won"])[1:3] == (4, 0.5) and set(found) == {"age", "won"}
    assert (found["age"]["min"], found["age"]["q1"], found["age"]["median"], found["age"]["max"]) == (20.0, 50.0, 60.5, 70.0)
    empty = query.describe(spark.createDataFrame([], "x double, s string")).first()
    assert tuple(empty) == ("x", 0, None, None, None, None, None, None, None)
    assert query.describe(riders.select("g")).isEmpty()


def test_log_target_round_trip(spark):
    df = spark.createDataFrame([(0.0,), (9.0,)], "y double")
    back = target.unlog_target(target.log_target(df, "y"), "y_log", "b")
    assert [r["b"] for r in back.collect()] == pytest.approx([0.0, 9.0])
    assert math.isclose(target.log_target(df, "y").collect()[1]["y_log"], math.log(10))


def test_rows_keep_order_free_equality(spark, riders):
    assert same_rows(riders, riders.repartition(3))


def test_resample_fills_empty_periods(spark):
    rows = [("a", "2024-01-31"), ("a", "2024-03-01"), ("a", "2024-03-02"), (None, "2023-12-30"), (None, None), ("b", None)]
    df = spark.createDataFrame(rows, "g string, d string").withColumn("t", F.to_date("d")).withColumn("v", F.lit(2))
    aggs = {"n": ("count", "*"), "s": ("sum", "v"), "m": ("mean", "v")}
    got = query.resample(df, "t", "month", aggs, ["g"]).orderBy("g", "period").collect()
    assert [(r["g"], f"{r['period']:%y-%m}", r["n"], r["s"], r["m"]) for r in got] == [
        (None, "23-12", 1, 2, 2.0), ("a", "24-01", 1, 2, 2.0), ("a", "24-02", 0, 0, None), ("a", "24-03", 2, 4, 2.0),
    ]
    assert query.resample(df, "t", "week", {"n": ("count", "*")}).count() == 10
    assert query.resample(df.filter("1 = 0"), "t", "day", aggs).collect() == []
    with pytest.raises(ValueError):
        query.resample(df, "t", "eon", aggs)


@pytest.mark.parametrize("block, cell", [(1_000, 64), (3, 7), (3, 500)])
def test_every_vector_as_query_on_the_grid(spark, block, cell):
    """Copies of one vector are a third of the corpus; ties go to the smaller ids."""
    rng = np.random.default_rng(5)
    vectors = [rng.normal(size=6).tolist() for _ in range(60)] + [[1.0, 0.5, 0.0, 0.0, 0.0, 0.0]] * 30 + [[0.0] * 6]
    rows = [(i % 40, f"t{i}", v) for i, v in enumerate(vectors)] + [(99, "none", None)]
    corpus = spark.createDataFrame(rows, "id int, t string, vector array<double>").repartition(4)
    queries = corpus.select(F.concat("t", F.lit("?")).alias("query_id"), "vector")
    got = retrieval.top_matches(corpus, queries, ["id", "t"], 4, None, block=block, cell=cell).collect()
    unit = np.array(vectors) / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    scores = np.round(unit @ unit.T, 10)
    want = {}
    for q in range(len(vectors)):
        order = sorted(range(len(vectors)), key=lambda j: (-scores[q, j], rows[j][0], rows[j][1]))[:4]
        want |= {(f"t{q}?", rank + 1): rows[j][1] for rank, j in enumerate(order)}
    assert {(r["query_id"], r["rank"]): r["t"] for r in got} == want
    assert retrieval.top_matches(corpus, queries.limit(0), ["id"], 4, block=block, cell=cell).collect() == []
    assert retrieval.top_matches(corpus.limit(0), queries, ["id"], 4, block=block, cell=cell).collect() == []


def test_word_vectors_equal_plain_weights(spark):
    texts = ["Alpha beta, beta!", "alpha  ", " ", "...", "été beta_1 alpha"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    vectors = retrieval.TextVectors(16).fit(df)
    got = {r["id"]: r["vector"] for r in vectors.transform(df).collect()}
    assert set(got) == {0, 1, 3, 4} and got[3] == [0.0] * 16
    words = {0: ["alpha", "beta", "beta"], 1: ["alpha"], 3: [], 4: ["été", "beta_1", "alpha"]}
    codes = {i: [retrieval._feature(w, 16) for w in ws] for i, ws in words.items()}
    raw = {i: [c.count(f) * math.log(5 / (sum(f in x for x in codes.values()) + 1)) for f in range(16)] for i, c in codes.items()}
    for i, values in raw.items():
        size = math.sqrt(sum(v * v for v in values)) or 1.0
        assert np.allclose(got[i], [v / size for v in values], atol=1e-6)


def test_parts_of_the_grid_are_few():
    """Every vector is copied once for each part of the other side."""
    assert [retrieval._parts(n, 512) for n in (0, 100, 2000, 120_000, 524_288)] == [1, 1, 4, 16, 16]
    assert retrieval._parts(10_000_000, 512) == math.ceil(10_000_000 / 32_768)


@pytest.mark.parametrize("scores", [1, 50, 4_194_304])
def test_nearest_equal_all_scores(monkeypatch, scores):
    monkeypatch.setattr(retrieval, "SCORE_BLOCK", scores)
    rng = np.random.default_rng(4)
    vectors = np.round(rng.normal(size=(40, 3)), 1)
    vectors = np.concatenate([vectors, vectors[:20], np.zeros((3, 3)), vectors[:5] * 2])  # equal vectors and scores
    part = pd.DataFrame({"id": rng.permutation(len(vectors)), "vector": list(vectors)})
    for size in (1, 3, 20, len(part)):
        some = part.head(size).reset_index(drop=True)
        got = retrieval._nearest(some, list(range(9)), retrieval._unit_rows(vectors[:9]), ["id"], ["id"], 3)
        every = np.round(retrieval._unit_rows(vectors[:9]) @ retrieval._unit_rows(some["vector"]).T, 10)
        for q in range(9):
            want = sorted(zip(-every[q], some["id"]))[:3]
            mine = got[got["query_id"] == q]
            assert list(zip(-mine["score"], mine["id"])) == want
