from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline.config import NULL_TOKENS
from plumbline.operators import merge
from plumbline.operators.profile import numeric_profile
from plumbline.plans.run import clean
from plumbline.session import materialize, run_scope, shared_dir
from plumbline.sources import tables
from plumbline.streaming.profile_stream import ProfileStream
from tests.conftest import same_rows


def test_csv_types_and_tokens(spark, tmp_path):
    lines = ["id,name,score,flag,token,code"]
    for i, token in enumerate(NULL_TOKENS):
        name = f'"a, ""{i}"""' if i else '"first\nsecond"'
        lines.append(f"{i},{name},{i}.5,{i % 2 == 0},{token},{'x' if i == 3 else i}")
    path = tmp_path / "t.csv"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    df = tables.read_csv(spark, str(path))
    assert [t for _, t in df.dtypes] == ["bigint", "string", "double", "boolean", "double", "string"]
    assert tables.has_multiline_cells(spark, str(path))
    rows = df.orderBy("id").collect()
    assert len(rows) == 19 and rows[0]["name"] == "first\nsecond" and rows[1]["name"] == 'a, "1"'
    assert all(r["token"] is None for r in rows)
    typed = tables.read_csv(spark, str(path), "id int, name string, score double, flag boolean, token string, code double")
    assert typed.dtypes[0] == ("id", "int") and typed.filter("code is null").count() == 1


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", x', 1.5), (2, None, None), (3, "new\nline", 2.0)], "a bigint, b string, c double")
    tables.write_csv(df, str(tmp_path / "out"))
    assert same_rows(tables.read_csv(spark, str(tmp_path / "out")), df)


def test_single_line_csv_stays_splittable(spark, tmp_path):
    tables.write_csv(spark.range(10), str(tmp_path / "plain"))
    assert not tables.has_multiline_cells(spark, str(tmp_path / "plain"))


def test_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("één\ntwo", encoding="utf-8")
    row = tables.read_text(spark, str(tmp_path / "a.txt")).first()
    assert row["text"] == "één\ntwo" and row["doc_id"].endswith("a.txt")


def test_preview_and_compare(spark):
    raw = spark.createDataFrame([(3, None), (1, "a"), (2, None)], "k int, s string")
    assert [r["k"] for r in tables.preview(raw, ["k"], 2).collect()] == [1, 2]
    rows = {r["version"]: r for r in tables.compare(raw, raw.na.drop()).collect()}
    assert (rows["raw"]["rows"], rows["raw"]["nulls"], rows["cleaned"]["rows"]) == (3, 2, 1)


def test_materialized_table_is_the_same(spark):
    df = spark.createDataFrame([(1, "a")], "`odd, name ()` int, `b.c` string")
    cut = materialize(df)
    assert cut.columns == df.columns and same_rows(cut.toDF("x", "y"), df.toDF("x", "y"))
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.mark.parametrize("replay", [False, True])
def test_stream_profile(spark, tmp_path, replay):
    source, folder = tmp_path / "in", str(tmp_path / "profile")
    table = spark.range(300).select("id", (F.col("id") % 17 * 1.5).alias("x"), F.concat(F.lit("s"), F.col("id") % 4).alias("s"))
    for part in range(3):
        table.filter(F.col("id") % 3 == part).coalesce(1).write.mode("append").parquet(str(source))
    follower = ProfileStream(folder)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    follower.start(stream, str(tmp_path / "cp"), availableNow=True).awaitTermination(120)
    if replay:  # a batch that ran twice
        first = spark.read.parquet(str(source)).filter(F.col("id") < 0)
        states = spark.read.parquet(f"{folder}/states").filter("batch = 0")
        assert states.count() == 3 and first.isEmpty()
        sizes = states.filter("column = 'x'").first()["n"]
        batch = table.filter(F.col("id") % 3 == 0).limit(sizes)
        before = follower.profile(spark).filter("column = 'x'").first()["rows"]
        follower.update(batch, 0)
        assert follower.profile(spark).filter("column = 'x'").first()["rows"] == before
        return
    merged = {r["column"]: r for r in follower.profile(spark).collect()}
    whole = numeric_profile(table, ["x"]).first()
    assert merged["x"]["rows"] == 300 and merged["x"]["mean"] == whole["mean"]
    assert merged["x"]["skewness"] == whole["skewness"]
    top = follower.top_values(spark).filter("column = 's'").orderBy("position").collect()
    assert [(r["value"], r["count"]) for r in top] == [(f"s{i}", 75) for i in range(4)]


def test_stream_states_are_combined_by_levels(spark, tmp_path):
    table = spark.range(700).select("id", (F.col("id") % 17 * 1.5 + F.col("id")).alias("x"), F.concat(F.lit("s"), F.col("id") % 4).alias("s"))
    part = lambda b: table.filter((F.col("id") >= b * 70) & (F.col("id") < b * 70 + 70))
    follower = ProfileStream(str(tmp_path / "p"), fan=3)
    for b in range(10):
        follower.update(part(b), b)
    # Nine batches are one folder, the tenth its own.
    assert sorted(follower._finished(spark, "states")) == [(0, 9), (9, 1)]
    want = {r["column"]: r for r in merge.merge_states(merge.profile_states(table)).collect()}

    def check():
        for c, r in {r["column"]: r for r in follower.profile(spark).collect()}.items():
            for name in ("rows", "null_count", "mean", "std", "min", "max", "skewness", "type_category"):
                assert r[name] == want[c][name], (c, name)
            assert r["approx_unique_count"] == pytest.approx(want[c]["approx_unique_count"], rel=0.05)
        top = follower.top_values(spark).filter("column = 's'").collect()
        assert {(r["value"], r["count"]) for r in top} == {(f"s{i}", 175) for i in range(4)}

    check()
    follower.update(part(4), 4)  # replayed after it was combined
    check()
    # A failure after a combined folder was written leaves parts behind that count no more.
    merge.profile_states(part(1), chunk=F.lit("1")).write.parquet(follower._folder("states", 1))
    check()


def test_merge_of_merges_equals_one_merge(spark):
    df = spark.range(999).select((F.sqrt("id") - 9).alias("x"), F.lit(None).cast("double").alias("none"), (F.col("id") % 9).alias("k"))
    states = materialize(merge.profile_states(df, ["x", "none"], F.col("k")))
    halves = materialize(merge.combine_states(states, F.col("chunk").cast("int") % 2))
    assert halves.columns == states.columns and halves.count() == 4
    one, two = ({r["column"]: r.asDict() for r in merge.merge_states(s).collect()} for s in (states, halves))
    for c in ("x", "none"):
        # What sketches say may differ within their error.
        near = one[c].pop("approx_median"), two[c].pop("approx_median")
        assert near[0] == near[1] or abs(near[0] - near[1]) < 0.2
        assert two[c].pop("approx_unique_count") == pytest.approx(one[c].pop("approx_unique_count"), rel=0.05)
        assert one[c] == two[c]


def test_run_scope_leaves_nothing_behind(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i % 3}", float(i % 7) if i % 5 else None) for i in range(60)], "id int, name string, v double")
    rows = rows.unionByName(rows.limit(3))
    folder = Path(shared_dir(spark))
    before = {p.name for p in folder.iterdir()}
    with run_scope(spark):
        result = clean(rows, ["id"], target="v")
        assert {p.name for p in folder.iterdir()} > before
        with run_scope(spark):
            inner = materialize(rows)
            assert inner.count() == 63
        result.cleaned.write.parquet(str(tmp_path / "out"))
    assert {p.name for p in folder.iterdir()} == before
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60
    with pytest.raises(ValueError), run_scope(spark):
        materialize(rows)
        raise ValueError
    assert {p.name for p in folder.iterdir()} == before
