"""Near-duplicate classes against brute force, and the signature's expectation."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import near_dup
from plumbline.llm.words import mix


def bag(text):
    words = (text or "").lower().split()
    if not words:
        return Counter()
    if len(words) < 5:
        return Counter([tuple(words)])
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_classes(rows, similar=0.8):
    """doc_id -> smallest doc_id of its connected class; texts compared pair by pair."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = [bag(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            (_, a), (_, b) = rows[i], rows[j]
            if a is None or b is None:
                continue
            union = sum((bags[i] | bags[j]).values())
            if a == b or union and sum((bags[i] & bags[j]).values()) >= similar * union - 1e-9:
                parent[root(i)] = root(j)
    least: dict = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return {doc: least[root(i)] for i, (doc, _) in enumerate(rows)}


def near_texts(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 200))]
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 8])):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    # A chain: each text is near the next only.
    chain = [word() for _ in range(400)]
    rows += [" ".join(chain[i * 12 : i * 12 + 160]) for i in range(14)]
    # Repeats count: two bags of equal sets but unequal multiplicities.
    line = " ".join(word() for _ in range(10))
    rows += [" ".join([line] * 10), " ".join([line] * 9), " ".join([line] * 3)]
    rows += [None, None, "", "", "   ", "one", "One", "two words", "a b c d", "a b c d e", "x " * 3000, "x " * 2900]
    rng.shuffle(rows)
    return rows


def test_classes_equal_brute_force(spark):
    rows = list(enumerate(near_texts(), start=100))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1))
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_classes(frame).collect()}
    assert got == brute_classes(rows)


def crowd_classes(spark, texts, piles, similar, monkeypatch):
    """The classes that the search by differences finds, the pairs it checked, and those from all pairs."""
    bags = [bag(t) for t in texts]
    rows = [(i, i, sum(b.values()), pile, piles.count(pile), t) for i, (b, t, pile) in enumerate(zip(bags, texts, piles))]
    crowd = spark.createDataFrame(rows, "node long, label long, size long, pile long, texts long, text string")
    none, unknown = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "node long, label long")
    asked = []
    links = near_dup._links
    monkeypatch.setattr(near_dup, "_links", lambda pairs, *rest: asked.append(pairs) or links(pairs, *rest))
    found = near_dup._crowd_labels(crowd, crowd.select("node", "text"), unknown, none, similar)
    got = {r["node"]: r["label"] for r in found.collect()}
    checked = [(r["a"], r["b"]) for p in asked for r in p.collect()]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            shared, whole = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if piles[i] == piles[j] and shared >= similar * whole - 1e-9:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    monkeypatch.undo()
    return [got.get(i, i) for i in range(len(texts))], checked, group


@pytest.mark.parametrize("similar", [0.8, 0.5])
def test_differences_connect_all_similar_texts(spark, monkeypatch, similar):
    texts = sorted({t for t in near_texts(2) if t and t.strip()})
    got, checked, want = crowd_classes(spark, texts, [i % 2 for i in range(len(texts))], similar, monkeypatch)
    assert got == want and len(set(want)) < len(want)
    assert len(checked) == len(set(checked)) < len(texts) ** 2 / 8


def test_texts_that_share_a_difference_are_not_paired(spark, monkeypatch):
    """Half of a pile shares a passage that the other half does not have; each half is a class of near texts."""
    monkeypatch.setattr(near_dup, "PART_TEXTS", 7)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(150):
        copy = list(base)
        if k % 2:
            copy[40:70] = [f"p{i}" for i in range(30)]
        copy[rng.randrange(120)] = f"own{k}"
        texts.append(" ".join(copy))
    got, checked, want = crowd_classes(spark, texts, [0] * 150, 0.8, monkeypatch)
    assert got == want and len(set(want)) < 60
    assert len(checked) < 20 * len(texts)


def test_large_buckets_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL_BUCKET", 0)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    # Copies of a text that is not there: some are near each other, most are not.
    copies = []
    for k in range(60):
        copy = list(base)
        for i in rng.sample(range(60), rng.choice([1, 2, 2, 3])):
            copy[i] = f"own{k}x{i}"
        copies.append(" ".join(copy))
    rows = list(enumerate(near_texts(3) + copies))
    got = near_dup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(rows)


def test_one_document_of_each_class_stays(spark):
    rows = list(enumerate(near_texts(4), start=100))
    rows += [rows[5], rows[5]]  # repeated rows
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame = frame.withColumns({"row": F.lit("r"), "digest": F.lit(2.5), "key": F.lit(True)})
    out = near_dup.one_of_each(frame)
    assert out.columns == frame.columns and out.dtypes == frame.dtypes
    classes = brute_classes(rows)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(d for d, c in classes.items() if d == c)


def test_near_texts_under_one_id_leave_one(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(3, " ".join(words)), (3, " ".join([*words[:-1], "z"])), (5, " ".join(["y", *words[1:]])), (7, None), (7, None)]
    rows += [(None, "no id here at all " * 9), (None, "no id here at all " * 9 + "end")]
    out = near_dup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["text"] is None) for r in out if r["doc_id"] is not None) == [
        (False, 3, False), (False, 7, True), (False, 7, True),
    ]
    assert len([r for r in out if r["doc_id"] is None]) == 1


def test_rows_without_id_keep_their_text(spark):
    rows = [(None, "a text that only a row without id has"), (None, "a text that only a row without id has"), (4, "other words altogether in here")]
    out = near_dup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["text"] for r in out) == sorted({t for _, t in rows})


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.near_classes(none).isEmpty() and near_dup.one_of_each(none).isEmpty()


def test_signatures_estimate_the_weighted_similarity():
    rng = np.random.default_rng(0)
    for top in (1, 3, 40):
        element = mix(np.arange(1, 201, dtype=np.uint64))
        a = rng.integers(0, top + 1, 200)
        b = np.where(rng.random(200) < 0.7, a, rng.integers(0, top + 1, 200))
        text = np.repeat([0, 1], [np.count_nonzero(a), np.count_nonzero(b)])
        both = np.concatenate([element[a > 0], element[b > 0]])
        times = np.concatenate([a[a > 0], b[b > 0]])
        size = 20_000
        one, two = near_dup.bag_minhash(text, both, times, 2, size)
        expected = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((one == two).mean() - expected) < 4 * np.sqrt(expected * (1 - expected) / size)


def test_signature_does_not_depend_on_other_texts():
    element = mix(np.arange(1, 50, dtype=np.uint64))
    alone = near_dup.bag_minhash(np.zeros(49, np.int64), element, np.full(49, 2), 1, 160)
    many = near_dup.bag_minhash(np.repeat([0, 1, 2], 49), np.tile(element, 3), np.repeat([1, 2, 7], 49), 3, 160)
    assert (alone[0] == many[1]).all() and (near_dup.bag_minhash(np.zeros(0, np.int64), element[:0], np.zeros(0, np.int64), 2, 8) == 0).all()


def test_long_chains_are_one_class(spark):
    links = spark.range(1, 300).select((F.col("id") - 1).alias("a"), F.col("id").alias("b"))
    assert {r["label"] for r in near_dup.classes(links).collect()} == {0}


def test_more_links_extend_the_labels(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    edges = [(min(e), max(e)) for e in edges if e[0] != e[1]]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    labels = near_dup.classes(frame(edges[:40]))
    for part in (edges[40:41], edges[41:90], [], edges[90:]):
        labels = near_dup._extended(labels, frame(part))
    assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, near_dup.classes(frame(edges)).collect()))
