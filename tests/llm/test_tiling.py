"""Greedy string tiling against a plain version on small texts."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import tiling

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def plain_tiles(doc, item, least=5):
    """Covered words of the item: the longest unmarked common run is marked, again and again."""
    doc_marked, item_marked = [False] * len(doc), [False] * len(item)
    covered = 0
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while (
                    i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]
                    and not doc_marked[i + n] and not item_marked[j + n]
                ):
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered
        doc_marked[i : i + n] = [True] * n
        item_marked[j : j + n] = [True] * n
        covered += n


def test_tiles_equal_the_plain_version():
    rng = random.Random(2)
    for _ in range(150):
        item = [rng.choice("abcdefghijklmnop") * 2 for _ in range(rng.randint(5, 30))]
        doc = []
        for _ in range(rng.randint(1, 5)):
            a = rng.randrange(len(item))
            doc += item[a : a + rng.randint(1, 20)] + [rng.choice("abcxyz") * 2 for _ in range(rng.randint(0, 3))]
        seeds = tiling.Seeds([1], [" ".join(item)])
        got = list(tiling._tiled(seeds, ["other text", " ".join(doc)], 0.0))
        covered = sum(n for *_, n in got[0][2]) if got else 0
        # Of equally long matches the first by place in the document, then in the item, as in the plain version.
        assert covered == plain_tiles(doc, item)
        for _, _, tiles, _ in got:
            for d, i, n in tiles:
                assert n >= 5 and doc[d : d + n] == item[i : i + n]
            marked = [k for d, _, n in tiles for k in range(d, d + n)]
            assert len(marked) == len(set(marked))
            marked = [k for _, i, n in tiles for k in range(i, i + n)]
            assert len(marked) == len(set(marked))


def test_short_items_are_found_whole(spark):
    items = [(1, "Blue, moon rising"), (2, "xylophone"), (3, "moon rising"), (4, "one two three four five"), (5, None), (6, "moon rising")]
    docs = [(1, "a blue moon - rising"), (2, "moon blue rising moon"), (3, "xylophone xylophone"), (4, "rising"), (5, None)]
    docs += [(6, "moon"), (7, "rising one two three four five")]
    benchmark = spark.createDataFrame(items, ITEMS)
    frame = spark.createDataFrame(docs, DOCS)
    got = {(r["doc_id"], r["item_id"]): (r["covered"], r["tiles"][0]["doc_start"]) for r in tiling.contaminated(frame, benchmark).collect()}
    assert got == {(1, 1): (3, 1), (1, 3): (2, 2), (1, 6): (2, 2), (3, 2): (1, 0), (7, 4): (5, 1)}
    only = benchmark.where("item_id in (2, 3)")
    assert {r["doc_id"] for r in tiling.without_contaminated(frame, only).collect()} == {2, 4, 5, 6, 7}


def case(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [[word() for _ in range(rng.randint(20, 50))] for _ in range(8)]
    fill = lambda n: [word() for _ in range(n)]
    docs = [
        fill(80),
        fill(30) + items[0] + fill(30),
        items[1][15:] + fill(10) + items[1][:15],  # reordered
        fill(5) + items[2][:6] + fill(5),  # a small part only
        fill(20) + items[3] + items[4] + fill(9),
        fill(3) + [w.upper() + "," for w in items[5]],
        [],
        items[6] * 50,
        fill(30_000) + items[7],
    ]
    rows = [*enumerate([" ".join(d) for d in docs]), (100, None), (1, " ".join(docs[1])), (None, " ".join(items[0]))]
    bench = [*enumerate([" ".join(i) for i in items]), (50, None), (51, ""), (52, "too short"), (0, " ".join(items[0]))]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(bench, ITEMS)


HITS = [(1, 0), (2, 1), (4, 3), (4, 4), (5, 5), (7, 6), (8, 7)]


def test_contaminated_documents_are_found(spark):
    docs, bench = case(spark)
    rows = tiling.contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {*HITS, (None, 0)}
    # Repeated documents and items are reported each.
    assert sum((r["doc_id"], r["item_id"]) == (1, 0) for r in rows) == 4
    assert all(r["coverage"] == r["covered"] / r["item_words"] >= 0.5 for r in rows)


def test_blocks_of_the_benchmark_give_the_same(spark):
    docs, bench = case(spark)
    key = lambda r: str((r["doc_id"], r["item_id"], r["tiles"]))
    whole = sorted(map(key, tiling.contaminated(docs, bench).collect()))
    assert sorted(map(key, tiling.contaminated(docs, bench, block_words=60).collect())) == whole


def test_the_stage_drops_them_and_keeps_all_else(spark):
    docs, bench = case(spark)
    docs = docs.withColumns({"batch": F.lit(1), "kept": F.array(F.lit(1.5), F.lit(None)), "when": F.lit("2020-01-01").cast("date")})
    for words_held in (60, 1_000_000):
        out = tiling.without_contaminated(docs, bench, block_words=words_held)
        assert out.dtypes == docs.dtypes
        assert sorted(map(str, (r["doc_id"] for r in out.collect()))) == ["0", "100", "3", "6"]


def test_empty_tables(spark):
    docs, bench = case(spark)
    none, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert tiling.contaminated(none, bench).isEmpty() and tiling.contaminated(docs, no_items).isEmpty()
    assert tiling.without_contaminated(none, bench).isEmpty()
    assert tiling.without_contaminated(docs, no_items).count() == docs.count()


def test_one_word_repeated_is_no_trap():
    seeds = tiling.Seeds([1], ["la " * 40])
    got = list(tiling._tiled(seeds, ["la " * 4000], 0.5))
    assert got[0][3] == 1.0 and np.isclose(sum(n for *_, n in got[0][2]), 40)
