"""Site quality, language and toxicity: brute-force parts, held-out accuracy, awkward rows."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import crf, queries, site_quality, toxicity
from plumbline.llm.words import mix, word_hashes

SF = "/root/testdata/sf0.01"
ODD = [None, "", "   ", "123 !!", "a", "x" * 100_000, "word " * 20_000]


def docs_of(spark, texts):
    rows = [(i, t, None if i % 2 else "en", "site") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


# Language


def brute_marginals(scores, transitions):
    n, k = scores.shape
    total = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        weight = np.exp(sum(scores[i, y] for i, y in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:])))
        for i, y in enumerate(path):
            total[i, y] += weight
    return total / total.sum(axis=1, keepdims=True)


def test_forward_backward_equals_all_paths(monkeypatch):
    rng = np.random.default_rng(1)
    for stretch in (1, 2, 3, 64):
        monkeypatch.setattr(crf, "STRETCH", stretch)
        counts = np.array([3, 0, 1, 7, 6])
        scores = rng.normal(size=(counts.sum(), 3)) * 3
        transitions = rng.normal(size=(3, 3)) * 2
        got = crf.marginals(scores, counts, transitions)
        end = 0
        for n in counts:
            if n:
                assert np.allclose(got[end : end + n], brute_marginals(scores[end : end + n], transitions))
            end += n


def test_pair_probabilities_equal_all_paths():
    rng = np.random.default_rng(2)
    counts = np.array([3, 0, 1, 6, 3])
    scores = rng.normal(size=(counts.sum(), 3)) * 3
    transitions = rng.normal(size=(3, 3)) * 2
    p, pairs = crf.expectations(scores, counts, transitions)
    want, end = np.zeros((3, 3)), 0
    for n in counts:
        if not n:
            continue
        own = scores[end : end + n]
        assert np.allclose(p[end : end + n], brute_marginals(own, transitions))
        sums, total = np.zeros((3, 3)), 0.0
        for path in itertools.product(range(3), repeat=int(n)):
            moves = list(zip(path, path[1:]))
            weight = np.exp(sum(own[i, y] for i, y in enumerate(path)) + sum(transitions[m] for m in moves))
            total += weight
            for m in moves:
                sums[m] += weight
        want += sums / total
        end += n
    assert np.allclose(pairs, want)
    assert crf.expectations(scores[:0], counts[:0], transitions)[1].sum() == 0


def test_words_are_letters_only():
    words, counts = crf.letter_words(["½ ² Ⅷ", "a½b x²", "Grün1und_2", ""])
    assert words == ["a", "b", "x", "grün", "und"] and counts.tolist() == [0, 3, 2, 0]


def test_training_rows_of_one_language_leave_the_others(spark):
    rows = [(1, f"mass {i} " * 20, "en") for i in range(3_000)] + [(2, "same text " * 30, "fr")] * 500 + [(i, f"klein {i}", "de") for i in range(5, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    windows = crf.training_windows(docs, per_language=50)
    counts = Counter(lang for lang, _ in windows)
    assert counts["de"] == 4 and counts["en"] <= 100 and counts["fr"] <= 100 and counts["en"] >= 25
    assert sorted(windows) == sorted(crf.training_windows(docs.repartition(7), per_language=50))


def test_features_mark_word_ends_and_whole_words():
    def named(word):
        ids, owner = crf.features([word, "other"])
        return set(ids[owner == 0])

    assert len(named("ing") & named("singing")) >= 6  # suffix, inner runs
    assert named("abc") == named("abc") != named("abd")
    assert len(crf.features(["é" * 5000])[0]) == 1 + sum(5002 - n + 1 for n in crf.RUN_SIZES)


def test_switched_text_is_labelled_by_word(spark):
    rng = random.Random(3)
    word = {"aa": lambda: "ka" + rng.choice("abc") + rng.choice("xyz") + "ung", "bb": lambda: "lo" + rng.choice("rst") + "tion"}
    texts = [(lang, " ".join(make() for _ in range(40))) for lang, make in word.items() for _ in range(30)]
    model = crf.fit(texts)
    mixed = [" ".join([word["aa"]() for _ in range(12)] + [word["bb"]() for _ in range(20)])]
    row = crf.label_texts(docs_of(spark, mixed), model).first()
    assert row["lang_pred"] == "bb" and 0.5 < row["score"] < 0.75
    assert [(s["lang"], s["start"], s["length"]) for s in row["spans"]] == [("aa", 0, 12), ("bb", 12, 20)]
    assert model.transitions[0, 0] > model.transitions[0, 1] and model.transitions[1, 1] > model.transitions[1, 0]


def test_language_of_odd_texts(spark):
    model = crf.fit([("en", "the house and the garden"), ("de", "das haus und der garten")])
    frame = docs_of(spark, ODD).withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in crf.label_texts(frame, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in range(4))
    assert all(got[i][0] in ("en", "de") and 0.5 <= got[i][1] <= 1 for i in range(4, 7))
    none = crf.fit(crf.training_windows(docs_of(spark, []).select("doc_id", "text", "lang")))
    assert {r["lang_pred"] for r in crf.label_texts(frame, none).collect()} == {"und"}
    assert crf.label_texts(docs_of(spark, []), model).isEmpty()


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = queries.op9_language(spark, SF).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.97


# Toxicity


def brute_segments(scores):
    """Maximal segments by definition: the best segment, then the same left and right of it."""
    best, where = 0.0, None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            total = float(sum(scores[a:b]))
            if total > best + 1e-9:
                best, where = total, (a, b)
    if where is None:
        return []
    a, b = where
    left = brute_segments(scores[:a])
    right = [(x + b, y + b, s) for x, y, s in brute_segments(scores[b:])]
    return [*left, (a, b, best), *right]


def test_segments_equal_the_definition():
    rng = np.random.default_rng(4)
    for _ in range(200):
        scores = rng.normal(size=rng.integers(0, 25)) - 0.2  # no ties
        got = toxicity.segments(scores)
        want = brute_segments(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


def test_scale_solves_its_equation():
    scores, share = np.array([2.0, -0.5, 1.0]), np.array([0.05, 0.85, 0.1])
    x = toxicity.scale_of(scores, share)
    assert abs((share * np.exp(x * scores)).sum() - 1) < 1e-6


def test_place_counts_clean_texts_without_a_segment():
    # Best scores drawn from the law itself, cut off below the least score of a segment.
    rng = np.random.default_rng(3)
    scale, log_k, least = 2.0, -4.0, 1.5
    n = rng.integers(20, 400, 40_000).astype(float)
    best = (log_k + np.log(n) - np.log(-np.log(rng.random(len(n))))) / scale
    best[best < least] = 0.0
    assert 0.5 < np.mean(best == 0) < 0.99
    assert abs(toxicity.place_of(best, n, scale, least) - log_k) < 0.05
    # A text without a segment is evidence of its own, and no text at all is none.
    few = best > 0
    assert toxicity.place_of(best[few], n[few], scale, least) > log_k + 0.5
    assert toxicity.place_of(np.zeros(3), np.array([5.0, 0.0, 9.0]), scale, least) < 2.0
    assert toxicity.place_of(np.zeros(0), np.zeros(0), scale, least) == 0.0


def test_tokens_are_counted_exactly(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(60_000)}" for _ in range(800)) for _ in range(60)]
    labels = [i % 3 if i % 3 < 2 else None for i in range(60)]
    rows = [*zip(texts, labels), (None, 1), ("", 0)]
    counts, sums = toxicity.token_counts(spark.createDataFrame(rows, "text string, label int").repartition(7))
    bags = [set(t.split()) for t in texts]
    words = sorted(set().union(*bags))
    named = dict(zip(toxicity.tokens([" ".join(words)])[0].tolist(), words))
    assert len(named) == len(words)
    got = {named[int(r.token)]: (r.n, r.toxic, r.clean) for r in counts.itertuples()}
    of = lambda w, value: sum(w in b and (value < 0 or x == value) for b, x in zip(bags, labels))
    assert set(got) == set().union(*(b for b, x in zip(bags, labels) if x == 1))
    assert all(got[w] == (of(w, -1), of(w, 1), of(w, 0)) for w in rng.sample(sorted(got), 300))
    assert list(sums) == [sum(len(b) for b, x in zip(bags, labels) if v is None or x == v) for v in (None, 1, 0)]


def test_words_that_share_hash_bits_stay_apart(spark):
    # Clean texts hold words whose hashes begin with the same 18 bits as that of the toxic word.
    many = [f"w{i}" for i in range(1_500_000)]
    bits = mix(word_hashes(["vile", *many])) >> np.uint64(46)
    alike = [many[i] for i in np.flatnonzero(bits[1:] == bits[0])]
    assert alike
    texts = [f"plain text number{i} " + ("vile" if i % 5 == 0 else alike[i % len(alike)]) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300) if i % 2], "doc_id long, toxic int")
    docs = docs_of(spark, texts)
    rows = toxicity.score_texts(docs, toxicity.fit(docs, labels)).collect()
    assert {r["doc_id"] for r in rows if r["predicted"]} == {i for i in range(300) if i % 5 == 0}


def test_toxic_passages_are_found(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("bcdfg") + rng.choice("aeiou") + rng.choice("lmn") + rng.choice(["", "er", "a"])
    texts, labels = [], []
    for i in range(400):
        text = [word() for _ in range(rng.randint(20, 120))]
        if i % 5 == 0:
            at = rng.randrange(len(text))
            text[at:at] = ["vile", word(), "nasty", "vile"]
        texts.append(" ".join(text))
        labels.append((i, int(i % 5 == 0)))
    docs = docs_of(spark, texts)
    taught = spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, toxic int")
    rows = toxicity.score_texts(docs, toxicity.fit(docs, taught)).collect()
    assert all(r["predicted"] == dict(labels)[r["doc_id"]] for r in rows)
    hit = next(r for r in rows if r["doc_id"] == 10)
    assert "nasty" in " ".join(texts[10].split()[hit["passages"][0]["start"] :][: hit["passages"][0]["length"]])


def test_toxicity_of_odd_texts(spark):
    docs = docs_of(spark, [*ODD, "vile vile vile"]).withColumn("label", F.lit("clash"))
    labels = spark.createDataFrame([(7, 1), (6, 0), (5, 0), (5, None), (None, 1), (6, 0)], "doc_id long, toxic int")
    scores = [r["score"] for r in toxicity.score_texts(docs, toxicity.fit(docs, labels)).collect()]
    assert len(scores) == len(ODD) + 1 and all(0 <= s <= 1 for s in scores)
    model = toxicity.fit(docs, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score_texts(docs, model).collect()} == {0}
    assert toxicity.score_texts(docs_of(spark, []), model).isEmpty()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = queries.op10_toxicity(spark, sf).join(labels, "doc_id").join(docs, "doc_id").where("lang = 'en' and held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    found = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    # One toxic label in ten here stands on texts of junk without any such word.
    assert np.mean(found) > 0.85 and np.mean(clean) < 0.005


def test_toxicity_held_out_in_every_language(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = queries.op10_toxicity(spark, sf).where("held_out").join(labels, "doc_id").join(docs, "doc_id").toPandas()
    found = rows[rows.toxic == 1].groupby("lang").predicted.mean()
    assert found["en"] > 0.85 and found["fr"] > 0.8 and found["de"] > 0.8 and found["es"] > 0.6
    assert rows[rows.toxic == 0].predicted.mean() < 0.01


# Site quality


@pytest.fixture(scope="module")
def judged(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    taught = labels.where(F.col("doc_id") % 3 != 0)
    return site_quality.judge_sites(docs, taught).toPandas(), labels.toPandas()


def test_quality_held_out(judged):
    rows, labels = judged
    both = rows.merge(labels, on="doc_id")
    both = both[both.doc_id % 3 == 0]
    assert ((both.score >= 0.5) == (both.quality == 1)).mean() > 0.95
    assert both[both.quality == 1].kept.mean() > 0.98


def test_rates_equal_plain_sums(judged):
    rows, _ = judged
    odds = rows.score / (1 - rows.score)
    prior = rows.path_rate / (1 - rows.path_rate)
    assert np.allclose(np.log(odds) - np.log(prior), rows.evidence)
    # A host's rate differs between its documents by their own part only.
    assert rows.groupby("host").host_rate.std().max() < 0.02


def test_sparse_sites_follow_the_prior(spark):
    good, bad = "A plain sentence of words, as people write them. " * 8, "### $$$ %%% ||| " * 40
    rows = [(i, f"{good} {i}.", "en", "large") for i in range(60)] + [(100 + i, f"{bad} {i}", "en", "dump") for i in range(60)]
    rows += [(300, f"{good} x.", "en", "single"), (301, None, None, None), (302, "", "en", "dump"), (300, f"{good} x.", "en", "single")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("host", F.lit(0))
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(100 + i, 0) for i in range(20)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in site_quality.judge_sites(docs, labels).collect()}
    assert got[0]["host_rate"] > 0.7 and got[100]["host_rate"] < 0.3
    assert got[100]["host_rate"] < got[300]["host_rate"] < got[0]["host_rate"] + 0.1
    assert got[0]["kept"] and not got[100]["kept"] and got[300]["kept"]
    assert got[301]["host"] == "" and len(got) == 123


def test_quality_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    frame = docs_of(spark, ODD)
    assert {r["evidence"] for r in site_quality.judge_sites(frame, none).collect()} == {0.0}
    assert site_quality.judge_sites(docs_of(spark, []), none).isEmpty()
