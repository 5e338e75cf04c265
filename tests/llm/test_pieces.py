"""Pieces by distinct chunks against the library on whole texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import pieces, queries
from tests.conftest import SF

MODEL = queries.piece_model_path()

TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b   c", "\n", "a\nb \n c", "\t tab", "▁", "a▁b", " ▁ ",
    "<s> </s> <unk> <0x0A>", "\U0001f600 中文 œuvre", "\x00 \x01", "\xa0　​", "x" * 3_000,
    "word " * 2_000, " " * 40 + "end", "é ﬁ", "﻿bom", "\r\n \r\n",
]


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=MODEL)


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_the_model_is_taken_word_by_word():
    assert pieces._encoder(MODEL).separable


@pytest.mark.parametrize("separable", [True, False])
@pytest.mark.parametrize("marks", [(True, True), (False, False)])
def test_texts_equal_library(library, separable, marks):
    encoder = pieces.ChunkEncoder(MODEL)
    encoder.separable = separable
    texts = [t or "" for t in TEXTS]
    for _ in range(2):  # the second time from the table
        got = [ids_of(i) for i in encoder.encode(texts, *marks)]
        assert got == [library.encode(t, add_bos=marks[0], add_eos=marks[1]) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" ab▁\né.,Tthe0\U0001f600<s>"), max_size=40))
def test_random_texts_equal_library(text):
    encoder = pieces._encoder(MODEL)
    assert ids_of(encoder.encode([text], True, True)[0]) == encoder.model.encode(text, add_bos=True, add_eos=True)


def test_a_full_table_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHED_WORDS", 2)
    encoder = pieces.ChunkEncoder(MODEL)
    for text in ("one two three four five", "six one seven  two"):
        assert ids_of(encoder.encode([text], True, True)[0]) == library.encode(text, add_bos=True, add_eos=True)


def test_round_trip_of_a_table(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a b", "x"), (5, TEXTS[5], "x")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids string")
    encoded = pieces.encode_texts(docs, MODEL)
    got = pieces.decode_ids(encoded, MODEL).collect()
    assert len(got) == len(rows)
    for doc_id, ids, text in got:
        source = "a b" if doc_id is None else TEXTS[doc_id] or ""
        want = library.encode(source, add_bos=True, add_eos=True)
        assert ids_of(ids) == want and text == library.decode(want)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.decode_ids(pieces.encode_texts(empty, MODEL), MODEL).collect() == []


def test_query_equals_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, SF, "documents").collect()}
    rows = queries.op12_sentencepiece(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
