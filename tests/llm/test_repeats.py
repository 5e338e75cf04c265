"""Periodic runs against all diagonals, on random sequences and awkward texts."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import periodic, queries
from tests.compare import compare, connect
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(words):
    """Every run with its smallest period, from all lags."""
    n, found = len(words), []
    for p in range(1, n // 4 + 1):
        i = p
        while i < n:
            if words[i] != words[i - p]:
                i += 1
                continue
            first = i
            while i < n and words[i] == words[i - p]:
                i += 1
            run = (first - p, i - first + p, p)
            inner = any(s <= run[0] and s + length >= run[0] + run[1] for s, length, _ in found)
            if run[1] >= max(6, 4 * p) and not inner:
                found.append(run)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for start, length, p in runs for i in range(start + p, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=80))
def test_runs_of_few_words_equal_all_diagonals(words):
    found = periodic.find_runs(np.array(words, dtype=np.int64))
    assert sorted(found, key=lambda r: (r[0], r[2])) == all_runs(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=7), st.integers(1, 9)), max_size=6))
def test_runs_of_repeated_parts_equal_all_diagonals(parts):
    words = [w for part, times in parts for w in part * times]
    found = periodic.find_runs(np.array(words, dtype=np.int64))
    assert sorted(found, key=lambda r: (r[0], r[2])) == all_runs(words)


TEXTS = [
    None,
    "",
    " \n",
    "a a a a a",
    "a a a a a a",
    "a b a b a b a b",
    "a b a b a b a",
    "x y x y x y x y x y z z z z z z z z z z",
    "p q r s " * 9 + "t " + "p q r s " * 9,
    "a a b " * 5,
    "a\x00b a\x00c " * 6,
    "\xa0 \xa0 \xa0 \xa0 \xa0 \xa0 \xa0",
    "w " * 30_000,
    " ".join(f"w{i % 997}" for i in range(5_000)),
    " ".join(f"w{i}" for i in range(30_000)),
]


def test_awkward_texts(spark):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)] + [(None, TEXTS[5], "x"), (4, TEXTS[4], "x")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_words string")
    got = periodic.periodic_runs(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[r["doc_id"]] if r["doc_id"] is not None else TEXTS[5]
        words = WORD.findall(text or "")
        runs = [tuple(x) for x in r["runs"]]
        if len(words) < 6_000:
            assert runs == all_runs(words)
        assert r["n_words"] == len(words)
        assert r["collapsed"] == collapsed(words, runs)
    by_id = {r["doc_id"]: r for r in got}
    assert tuple(by_id[12]["best"]) == (0, 30_000, 1) and by_id[12]["collapsed"] == "w"
    assert tuple(by_id[13]["best"]) == (0, 5_000, 997)
    assert by_id[14]["best"] is None


def test_ties_of_the_best_run():
    assert periodic._best([(0, 8, 2), (10, 4, 1), (20, 12, 3)]) == (0, 8, 2)
    assert periodic._best([(0, 9, 2), (3, 9, 2), (5, 15, 3)]) == (5, 15, 3)
    assert periodic._best([]) is None


def test_empty_table(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_planted_repeats_equal_plain_rule(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 41))) for i in range(400)]
    got = queries.with_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for doc_id, text in got:
        words = WORD.findall(rows[doc_id][1])
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert text.split() == words


def test_query_equals_sql_and_plain_digests(spark):
    assert compare(spark, connect(SF), "op13_periodic_runs", SF).startswith("ok (")
    row = queries.op13_periodic_runs(spark, SF).where("n_runs = 0").first()
    assert row["runs_sha256"] == hashlib.sha256(b"").hexdigest() and row["start"] is None
