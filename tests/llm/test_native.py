"""Quality rules, line dedup and chat formatting on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import chat, line_dedup, quality_rules
from tests.compare import compare, connect
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = " \t\n\x0b\x0c\r"


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], DOCS)


def split(text):
    return [w for w in re.split(f"[{SPACES}]+", text or "") if w]


AWKWARD = [
    None,
    "",
    " \n\t",
    "one",
    "a b",
    "a b c a b c a b c",
    "The The The The",
    "x\ny\nx\n\n \nx",
    "é ü\x0bñ\x0c##| 😀 😀",
    "\xa0non breaking\xa0space",
    "same words here " * 40,
    "w" * 50_000,
    " ".join(f"word{i}" for i in range(20_000)),
]


@pytest.mark.parametrize("name", ["op1_line_dedup", "op4_chat_format", "op5_quality_rules", "op8_warc"])
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF), name, SF).startswith("ok (")


def test_measures_equal_brute_force(spark):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs_of(spark, AWKWARD), iterations=2).collect()}
    for i, text in enumerate(AWKWARD):
        words = split(text)
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        times: dict = {}
        for w in windows:
            times[w] = times.get(w, 0) + 1
        covered = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if split(x)]
        r = got[i]
        assert r["n_words"] == len(words)
        assert r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == len(covered)
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_expectation_maximisation_equals_plain_loops(spark):
    votes = [f"v_{r[0]}" for r in quality_rules.RULES]
    n = len(votes)
    rows = [[1] * n + [900], [-1, 1, -1] + [1] * (n - 3) + [80], [1] * 3 + [0] * (n - 3) + [50], [0] * n + [3]]
    got = quality_rules.learn(spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{v} int" for v in [*votes, "n"])), 5)
    model = quality_rules.start()
    good, g, b = model.good, list(model.right_good), list(model.right_bad)
    for _ in range(5):
        post = []
        for row in rows:
            one, zero = math.log(good), math.log(1 - good)
            for j, v in enumerate(row[:n]):
                one += math.log(g[j]) if v == 1 else math.log(1 - g[j]) if v == -1 else 0
                zero += math.log(b[j]) if v == -1 else math.log(1 - b[j]) if v == 1 else 0
            post.append(1 / (1 + math.exp(zero - one)))
        G = [r[n] * p for r, p in zip(rows, post)]
        B = [r[n] - x for r, x in zip(rows, G)]
        up, down = quality_rules.ON_GOOD, quality_rules.ON_BAD
        g = [
            (sum(x for r, x in zip(rows, G) if r[j] == 1) + up[0]) / (sum(x for r, x in zip(rows, G) if r[j]) + sum(up))
            for j in range(n)
        ]
        b = [
            (sum(x for r, x in zip(rows, B) if r[j] == -1) + down[0]) / (sum(x for r, x in zip(rows, B) if r[j]) + sum(down))
            for j in range(n)
        ]
        good = (sum(G) + quality_rules.PRIOR_GOOD) / (sum(G) + sum(B) + quality_rules.PRIOR_GOOD + quality_rules.PRIOR_BAD)
    assert math.isclose(got.good, good)
    assert all(map(math.isclose, got.right_good, g)) and all(map(math.isclose, got.right_bad, b))


def test_rules_reject_junk_and_keep_clean_text(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    clean = [". ".join(" ".join(word() for _ in range(10)) for _ in range(7)) + "." for _ in range(60)]
    junk = [c.replace(" ", "### ") for c in clean[:12]]
    frame = docs_of(spark, clean + junk)
    kept = {r["doc_id"] for r in quality_rules.keep_good(frame).collect()}
    assert kept == set(range(60))


def test_rules_keep_all_columns_of_their_input(spark):
    frame = docs_of(spark, AWKWARD).withColumn("words", F.lit(1)).withColumn("row", F.lit("x")).withColumn("v_symbols", F.lit(0))
    out = quality_rules.keep_good(frame, iterations=1)
    assert out.columns == frame.columns and out.dtypes == frame.dtypes
    assert out.where("words <> 1 or row <> 'x'").isEmpty()


def test_empty_tables(spark):
    none = docs_of(spark, [])
    assert quality_rules.judge(none, iterations=1).isEmpty()
    assert quality_rules.keep_good(none, iterations=1).isEmpty()
    assert line_dedup.dedup_lines(none).isEmpty()
    assert line_dedup.without_recurring_lines(none).columns == none.columns
    assert chat.digests(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).isEmpty()


def test_recurring_lines_stay_in_one_document(spark):
    long = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    texts = [
        f"first own line\nPage 3 of 10\n{long}",
        f"second text here\nPage 4 of 10\n{long}\nsecond text here",
        f"{long}",
        None,
        "",
        "own\nown",
    ]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    assert got[0] == (texts[0], 3, 0)
    assert got[1] == ("second text here\nsecond text here", 4, 2)
    assert got[2] == ("", 1, 1)
    assert got[3] == (None, 0, 0)
    assert got[4] == ("", 1, 0)
    assert got[5] == ("own\nown", 2, 0)


def test_variable_fields_of_a_leaf_make_one_template(spark):
    texts = [f"user alice logged in from host {name} after the nightly restart ended" for name in ("alpha", "beta", "gamma")]
    other = ["a quite different line with a different count", "user alice logged out"]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs_of(spark, texts + other)).collect()}
    assert got == {0: texts[0], 1: "", 2: "", 3: other[0], 4: other[1]}


def test_lines_that_only_begin_alike_are_kept(spark):
    texts = [
        "the old house stood on a hill far away from town",
        "the old house was sold last year to someone we know",
        "the old house burned when nobody lived there any longer now",
    ]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    assert got == dict(enumerate(texts))


def test_a_foreign_line_does_not_undo_a_template(spark):
    texts = [f"user alice logged in from host {name} after the nightly restart ended" for name in ("alpha", "beta", "gamma")]
    foreign = "user alice logged no other thing than what she ever wanted to say"
    for place in range(4):
        mixed = [*texts[:place], foreign, *texts[place:]]
        got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(docs_of(spark, mixed)).collect()}
        assert sum(got.values()) == 2 and got[place if place else 0] == 0 and got[mixed.index(foreign)] == 0


def similar_lines(a, b):
    n, tail = len(a), max(len(a) - 3, 0)
    equal = sum(x == y for x, y in zip(a[3:], b[3:]))
    return len(b) == n and a[:3] == b[:3] and min(n, 3) + equal >= 0.7 * n and 2 * equal > tail


def test_lines_of_a_template_equal_all_pairs(spark):
    """Up to eight tokens behind the leading ones each token is a field, so that every pair counts."""
    rng = random.Random(12)
    lines = []
    for n in (4, 5, 6, 8, 9, 11):
        for stem in range(3):
            base = [f"s{chr(97 + stem)}", "b", "c", *(rng.choice("uvwxyz") for _ in range(n - 3))]
            for _ in range(25):
                line = list(base)
                for k in rng.sample(range(3, n), rng.randint(0, n - 3)):
                    line[k] = rng.choice("uvwxyz")
                lines.append(line)
    rng.shuffle(lines)
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(docs_of(spark, [" ".join(x) for x in lines])).collect()}
    for i, line in enumerate(lines):
        assert got[i] == any(line == other or similar_lines(line, other) for other in lines[:i])


def test_scattered_differences_of_long_lines(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(80)]
    lines = []
    for _ in range(12):
        line = list(base)
        for k in rng.sample(range(3, 80), 6):
            line[k] = word()
        lines.append(line)
    foreign = [[*base[:3], *(word() for _ in range(77))] for _ in range(6)]
    texts = [" ".join(x) for x in [*foreign, *lines]]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(18)] == [0] * 7 + [1] * 11


def test_short_lines_that_begin_alike_are_kept(spark):
    texts = [
        "he went home early\nthe red door was open\nthe old clock on wall struck twelve",
        "he went home late\nthe red door was shut\nthe old clock on wall stopped again",
    ]
    # Recurring short lines still go, with or without a number in them.
    texts = [f"{t}\nsee all our offers\nyou are visitor {i}" for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    assert got == {0: texts[0], 1: "\n".join(texts[1].split("\n")[:3])}


def test_line_dedup_keeps_rows_and_columns(spark):
    frame = docs_of(spark, ["a\nb", "a\nb", "a\nb", "a\nc", "a\nd"], [7, 7, None, None, 9]).withColumn("doc", F.lit(1)).withColumn("drop", F.lit(2))
    out = line_dedup.without_recurring_lines(frame)
    assert out.columns == frame.columns and out.count() == 5
    assert {(r["doc"], r["drop"]) for r in out.collect()} == {(1, 2)}
    assert [r["text"] for r in out.where("doc_id = 7").collect()] in (["a\nb", "a\nb"], ["", ""])
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


CHATS = [
    (1, 0, "user", "hello"),
    (1, 1, "assistant", "hi <|im_end|>\nthere"),
    (2, 0, "user", None),
    (2, 1, None, ""),
    (3, 0, "assistant", "<\\|im_start|> and <|im_start|> and <\\\\|im_end|>"),
    (3, 1, "assistant", "plain"),
    (4, 0, "a\nb\\n\\", "odd role <|im_end|>"),
    (5, 0, "<|im_start|>assistant", "role"),
    (6, 0, "user", "x" * 200_000 + "<|im_end|>" + "\n" * 1000),
    (7, 0, "user", "twice"),
    (7, 0, "user", "twice"),
    (None, 0, "user", "no id"),
    (8, None, "assistant", "no turn"),
    (9, 0, "user", "<\\|im_end|> looks escaped already"),
    (10, 0, "user", "ends with <|im_end"),
    (10, 1, "assistant", "|> begins so <|"),
]


def test_chats_survive_the_round_trip(spark):
    frame = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(frame.withColumn("formatted", F.lit("clash")).withColumn("source", F.lit("clash")))
    read = {r["conv_id"]: r for r in chats.select("*", chat.parse(F.col("formatted")).alias("turns")).collect()}
    digests = {r["conv_id"]: r for r in chat.digests(chats).collect()}
    by: dict = {}
    for conv, turn, role, text in CHATS:
        by.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    assert set(read) == set(by)
    for conv, turns in by.items():
        turns = [(role, text) for _, _, role, text in sorted(turns)]
        assert [(x["role"], x["text"]) for x in read[conv]["turns"]] == turns
        said = "".join(f"{role}\n{text}\n" for role, text in turns)
        loss = "".join(text for role, text in turns if role == "assistant")
        d = digests[conv]
        assert d["n_turns"] == len(turns)
        assert d["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (d["loss_chars"], d["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert read[conv]["formatted"].count(chat.START) == read[conv]["formatted"].count(chat.END) == len(turns)
    assert "looks escaped" in read[9]["formatted"] and read[1]["formatted"].startswith("<|im_start|>user\nhello<|im_end|>\n")


def test_native_plans_hold_no_python(spark):
    frame = docs_of(spark, ["a b c"])
    turns = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    for df in (quality_rules.judge(frame, 1), line_dedup.dedup_lines(frame), chat.digests(chat.format_chats(turns))):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("crowd", [10_000, 2])
def test_line_dedup_misses_no_line_of_a_template(spark, monkeypatch, crowd):
    """Against all pairs: many earlier lines share a field, and differences lie in every one of eight fields."""
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    word = lambda *x: "".join(chr(97 + v) for v in x)
    base = [word(i // 10, i % 10, 25) for i in range(40)]

    def line(changed, tag):
        return " ".join(word(i // 10, i % 10, tag) if i in changed else base[i] for i in range(40))

    lines = [line({i for i in range(5, 40) if i > 8}, 20 - k) for k in range(9)]  # share a field, are of no template
    lines += [line({3, 8, 12, 16, 21, 25, 30, 34, 38, 39}, 3), line(set(), 0), line({4, 9, 13, 17, 22, 26, 31, 35}, 4)]
    lines += [" ".join(base[:9] + [word(i // 10, i % 10, 12) for i in range(9, 40)][:25] + base[34:])]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(docs_of(spark, lines)).collect()}
    cut = [x.split() for x in lines]
    same = lambda a, b: sum(x == y for x, y in zip(a, b))
    near = lambda a, b: same(a, b) >= 0.7 * 40 and 2 * (same(a, b) - 3) > 37
    want = {i: int(any(near(a, b) for b in cut[:i])) for i, a in enumerate(cut)}
    assert sum(want.values()) >= 3
    assert got == want


def test_lines_of_a_template_are_not_paired_with_each_other(spark, monkeypatch):
    """The lines that meet grow with the lines of a template, not with their square."""
    rng = random.Random(3)
    lines = []
    for i in range(200):
        tail = [f"{'xy'[i % 2]}{'abcdefghijklmnopqrstuvwxyzA'[k]}" for k in range(27)]
        for k in rng.sample(range(27), 4):
            tail[k] = "other" + "".join(rng.choices("abcdef", k=8))
        lines.append(" ".join(["the", "page", "of", *tail]))
    met, write = [], line_dedup.materialize

    def counted(df):
        out = write(df)
        if out.columns == ["id", "head", "to"]:
            met.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "materialize", counted)
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(docs_of(spark, lines)).collect()}
    assert got == {i: int(i > 1) for i in range(200)}
    assert sum(met) <= 5 * len(lines)
