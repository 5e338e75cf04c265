"""The stages one after the other against brute force over the same rows."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from plumbline.llm import queries
from plumbline.llm.line_dedup import dedup_lines
from plumbline.llm.quality_rules import judge
from tests.llm.test_near_dup import brute_classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("steps")
    docs = queries.table(spark, SF, "documents")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns_of_documents_are_kept(steps):
    for step in steps[1:-1]:
        assert step.columns == steps[0].columns


def test_quality_stage_drops_what_the_rules_reject(steps):
    kept = {r["doc_id"] for r in judge(steps[0]).where("kept").collect()}
    assert texts(steps[1]).keys() == kept


def test_line_stage_rewrites_texts(steps):
    assert texts(steps[2]) == texts(dedup_lines(steps[1]))
    assert all(r["n_chars"] == len(r["text"]) for r in steps[2].collect())


def test_near_duplicate_stage_keeps_one_of_each(steps):
    rows = sorted(texts(steps[2]).items())
    classes = brute_classes(rows)
    assert sorted(texts(steps[3])) == sorted(d for d, c in classes.items() if d == c)


def test_decontamination_stage_drops_passages(spark, steps):
    items = [
        re.findall(r"\w+", r["text"].lower()) for r in queries.table(spark, SF, "benchmark").collect()
    ]
    left = texts(steps[4])
    for doc, text in texts(steps[3]).items():
        words = re.findall(r"\w+", text.lower())
        runs = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        share = 0.0
        for item in items:
            covered = {k for i in range(len(item) - 4) if tuple(item[i : i + 5]) in runs for k in range(i, i + 5)}
            share = max(share, len(covered) / len(item))
        # Between these, tiles that overlap could decide; there are none in this table.
        assert share < 0.4 or share > 0.9
        assert (doc in left) == (share < 0.4)


def test_packing_stage_places_every_token(steps):
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for doc, text in texts(steps[4]).items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        want += [
            (doc, k, zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))
        ]
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in steps[5].collect()) == sorted(want)


def test_run_equals_its_stages(spark, steps):
    rows = lambda df: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, SF)) == rows(steps[-1])


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_|pipeline$", n)]
    assert sorted(n.split("_")[0] for n in names) == sorted([f"op{k}" for k in range(1, 11)] + ["pipeline"])
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert [name for name, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None
