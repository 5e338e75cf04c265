"""Packing: pieces equal to the tokenizer's ids, gapless sequences, optimal small instances."""

from __future__ import annotations

import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import packing
from plumbline.session import materialize

PATH = public_tokenizers.path("word_bpe_49k.json")


@lru_cache(None)
def _fewest(sizes: tuple, rooms: tuple, capacity: int) -> int:
    """The fewest sequences for the sizes (longest first), by trying all ways."""
    if not sizes:
        return len(rooms)
    size, rest = sizes[0], sizes[1:]
    best = _fewest(rest, tuple(sorted([*rooms, capacity - size])), capacity)
    for room in set(rooms):
        if room >= size:
            left = list(rooms)
            left.remove(room)
            best = min(best, _fewest(rest, tuple(sorted([*left, room - size])), capacity))
    return best


def fewest(sizes, capacity):
    return _fewest(tuple(sorted(sizes, reverse=True)), (), capacity)


def count_of(sizes, capacity):
    return np.bincount(sizes, minlength=capacity + 1).astype(np.int64)


def test_fixed_sequences_never_cost_a_sequence():
    rng = random.Random(3)
    fixed_some = 0
    for _ in range(250):
        capacity = rng.choice([10, 13, 20])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 8))]
        count = count_of(sizes, capacity)
        fixed = packing.reduce_by_dominance(count, capacity)
        rest = [s for s in range(capacity + 1) for _ in range(count[s])]
        assert sorted(rest + [s for group, n in fixed for s in group * n]) == sorted(sizes)
        assert all(sum(group) <= capacity for group, _ in fixed)
        assert sum(n for _, n in fixed) + fewest(rest, capacity) == fewest(sizes, capacity)
        fixed_some += bool(fixed)
    assert fixed_some > 200


def check_runs(runs, histogram, capacity):
    """Every piece has one place, sequences have no gaps and do not overflow; how many there are."""
    filled: dict = {}
    for size, n in histogram.items():
        own = runs[runs["length"] == size].sort_values("low")
        assert list(own["low"]) == [0, *own["high"]][: len(own)] and own["high"].max() == n
    for r in runs.itertuples():
        for k in range(r.high - r.low):
            at = r.offset + k % r.per * r.length
            filled.setdefault(r.first + k // r.per, []).append((at, r.length))
    for places in filled.values():
        end = 0
        for at, length in sorted(places):
            assert at == end
            end += length
        assert end <= capacity
    return len(filled)


def test_plans_are_whole_and_close_to_optimal():
    rng = random.Random(5)
    for _ in range(60):
        capacity = rng.choice([12, 17])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        histogram = {s: sizes.count(s) for s in set(sizes)}
        n = check_runs(packing.plan(histogram, capacity), histogram, capacity)
        best = fewest(sizes, capacity)
        assert best <= n <= max(best + 1, best * 11 / 9 + 1)
    big = {s: rng.randint(1, 40) for s in rng.sample(range(1, 1200), 500)}
    n = check_runs(packing.plan(big, 2048), big, 2048)
    assert n <= 1.01 * -(-sum(s * c for s, c in big.items()) // 2048) + 1
    assert packing.plan({}, 2048).empty


def test_plan_size_does_not_follow_the_counts():
    rng = random.Random(9)
    few = {s: rng.randint(1, 50) for s in range(1, 2049)}
    many = {s: c * 1_000_000 for s, c in few.items()}
    assert len(packing.plan(many, 2048)) < 3 * len(packing.plan(few, 2048)) + 1000


TEXTS = [
    None,
    "",
    "  \n\t ",
    "Hello, world! it's 42 o'clock\r\nfin.",
    "naïve CAFÉ ﬁ ΑΣ Σ́ x́ \xa0a b\x85c",
    "<|endoftext|> <|startoftext|>x",
    "x <|endoftext|> y. <|ENDOFTEXT|> <|endof text|>",
    "a\x00b a\x00c \x00",
    "word " * 5000,
    "".join(chr(97 + i % 26) for i in range(9000)),
    "日本語のテキスト 😀😀 \x1c\x1d",
    "same",
    "same",
]


@pytest.fixture(scope="module")
def docs(spark):
    ids = [*range(len(TEXTS) - 1), len(TEXTS) - 2]  # the last row repeats the one before
    rows = [(None if i == 3 else i, t) for i, t in zip(ids, TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))


def expected_pieces():
    tokenizer = Tokenizer.from_file(PATH)
    for i, text in enumerate(TEXTS):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        doc = None if i == 3 else min(i, len(TEXTS) - 2)
        for k, start in enumerate(range(0, len(ids), 2048)):
            yield doc, k, start, ids[start : start + 2048]


def test_pieces_hold_the_tokenizers_ids(spark, docs):
    got = packing.token_pieces(docs, PATH).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["ids"]) for r in got), key=key) == sorted(expected_pieces(), key=key)
    assert all(r["length"] == len(r["ids"]) for r in got)


def test_added_tokens_are_one_id():
    flat, counts = packing.WordTokenizer(PATH).encode(["x <|endoftext|> y", "x y"])
    assert flat[:3].tolist() == [343, 49407, 344] and counts.tolist() == [3, 2]


def test_documents_are_packed_whole(spark, docs):
    rows = packing.packed_documents(docs, PATH).collect()
    want = sorted(zlib.crc32(np.array(ids, "<u4").tobytes()) for *_, ids in expected_pieces())
    assert sorted(r["ids_crc32"] for r in rows) == want
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for at, length in sorted(places):
            assert at == end
            end += length
        assert end <= 2048
    total = sum(r["length"] for r in rows)
    assert len(by) == -(-total // 2048)


def test_sequences_hold_the_ids(spark, docs):
    rows = packing.sequences(docs.select("doc_id", "text"), PATH).collect()
    assert sum(len(r["ids"]) for r in rows) == sum(len(ids) for *_, ids in expected_pieces())
    assert all(len(r["ids"]) <= 2048 for r in rows)


def test_equal_lengths_are_numbered_without_gaps(spark):
    pieces = materialize(spark.range(5000).select("id", (F.col("id") % 3 + 1).alias("length")))
    rows = packing.pack(pieces, 4).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 5000
    assert len({r["sequence_id"] for r in rows}) == -(-(1667 * 1 + 1667 * 2 + 1666 * 3) // 4)


def test_no_documents(spark):
    assert packing.packed_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).isEmpty()
