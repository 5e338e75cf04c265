"""Spelling variants against all pairs, with blocks of every size."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from plumbline.llm import queries, variants
from tests.compare import compare, connect
from tests.conftest import SF


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    for k in range(len(long)):
        if long[:k] + long[k + 1 :] == (short if len(short) < len(long) else short[:k] + short[k + 1 :]):
            return True
    return False


def plain(counts):
    """word: (form, root, n, n_near, form_n) from all pairs."""
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def grouped(spark, counts, **kw):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = variants.group_variants(words, **kw).collect()
    assert len(rows) == len(counts)
    return {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n")) for r in rows}


def vocabulary(seed, size, alphabet="abcé", lengths=(6, 9), stem=""):
    rng = random.Random(seed)
    counts = {}
    while len(counts) < size:
        word = stem + "".join(rng.choice(alphabet) for _ in range(rng.randint(*lengths)))
        counts[word] = 5 * 6 ** rng.randint(0, 4)
    return counts


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_groups_equal_all_pairs(spark, block):
    counts = vocabulary(1, 500)
    assert grouped(spark, counts, block=block) == plain(counts)


@pytest.mark.parametrize("block", [1, 1024])
def test_common_first_letters_and_odd_words(spark, block):
    counts = vocabulary(2, 200, "ab", (2, 7), stem="commonstem") | vocabulary(3, 25, "xy", (1, 4))
    counts |= {"a" * 300: 9, "a" * 299: 50, "a" * 150 + "b" + "a" * 149: 300, "中文字符测试": 6}
    counts |= {"中文字符测": 40, "z": 7, "": 8}
    assert grouped(spark, counts, block=block) == plain(counts)


def test_ties_go_to_the_smallest_word(spark):
    counts = {"letters": 5, "lettera": 25, "letterz": 25, "better\xe9": 5, "better\xff": 25}
    got = grouped(spark, counts)
    assert got["letters"] == ("lettera", "lettera", 5, 2, 25)
    assert got["better\xe9"][0] == "better\xff"


def test_chains_are_followed_to_the_end(spark):
    words = ["abcdef", "abcdeg", "abcdhg", "abcihg", "abjihg", "akjihg", "lkjihg"]
    counts = {w: 5**k for k, w in enumerate(words)}
    assert {v[1] for v in grouped(spark, counts).values()} == {"lkjihg"}


def counted(docs, alter):
    total = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if alter and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


@pytest.mark.parametrize("alter", [None, variants.thinned])
def test_counts_equal_plain_rule(spark, alter):
    rng = random.Random(4)
    words = ["PARTies", "\xc9cole\xd7ab", "stra\xdfen", "naœud-letters", "\U0001f600strange", "\xffwords", "x" * 5_000]
    docs = [(i, " ".join(rng.choice(words) for _ in range(60)) + "\nA1b2") for i in range(300)]
    docs += [(7, docs[7][1]), (None, "PARTies " * 9), (1, None), (2, "")]
    rows = [(i, t, "x") for i, t in docs]
    table = spark.createDataFrame(rows, "doc_id int, text string, word string")
    got = {r["word"]: r["n"] for r in variants.count_words(table, alter).collect()}
    assert got == counted(docs, alter)
    assert not alter or got != counted(docs, None)


def test_empty_table(spark):
    words = variants.count_words(spark.createDataFrame([], "doc_id long, text string"), variants.thinned)
    assert variants.group_variants(words).collect() == []


def test_query_equals_sql(spark):
    assert compare(spark, connect(SF), "op11_spelling_variants", SF).startswith("ok (")
    assert queries.op11_spelling_variants(spark, SF).where("form is not null").count() > 0
