"""SentencePiece encoding and decoding by a table of distinct chunks.

White space becomes a marker in front of the word. If no piece of the model holds a marker
behind another character, no piece can cross from one marked word to the next, merges in one
word never touch another, and each distinct marked word (its markers and what follows
them) has one segmentation wherever it stands. So the words of a slice of texts are numbered,
each distinct one is segmented once by the library, and the ids are joined back by
position. A table of words that were met before stays with the worker process, up to a
fixed number of words; beyond that a word is only segmented again. Texts never leave their task, so nothing
is shuffled.

A model of another build (other normalization, pieces across markers) is run over whole texts.

Cases: NULL is an empty text, which is the begin and end ids alone and decodes to an empty text.
Characters without a piece are bytes, so every text has ids. Repeated rows are encoded each. A
very long text is handled alone; a very long word is one chunk. Markers that stand in the text itself count as
white space, as in the library. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import numbered, slices

MARK = "▁"
CACHED_WORDS = 200_000

_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
_encoders: dict = {}


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class ChunkEncoder:
    """Ids of texts, each distinct marked word segmented once."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.separable = self._separable(path)
        # A lone marker cannot be given to the library as text.
        self.known: dict[str, bytes] = {MARK: _packed([self.model.piece_to_id(MARK)])}

    def _separable(self, path: str) -> bool:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        how, train = proto.normalizer_spec, proto.trainer_spec
        plain = not how.precompiled_charsmap and how.add_dummy_prefix and how.escape_whitespaces
        plain = plain and not how.remove_extra_whitespaces and not train.treat_whitespace_as_suffix
        pieces = [p.piece for p in proto.pieces]
        crossing = any(MARK in p.lstrip(MARK) for p in pieces)
        return plain and not crossing and MARK in pieces and train.model_type == train.BPE

    def _learn(self, chunks: list[str]) -> list[bytes]:
        # The library puts the first marker in front of what it is given.
        found = self.model.encode([c[1:] for c in chunks], num_threads=1)
        ids = list(map(_packed, found))
        if len(self.known) < CACHED_WORDS:
            self.known.update(zip(chunks, ids))
        return ids

    def encode(self, texts: list[str], begin: bool, end: bool) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        first, last = _packed([self.model.bos_id()] * begin), _packed([self.model.eos_id()] * end)
        if not self.separable:
            return [first + _packed(f) + last for f in self.model.encode(texts, num_threads=1)]
        chunks: list[str] = []
        counts = []
        for text in texts:
            found = _CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []
            chunks += found
            counts.append(len(found))
        codes, distinct = numbered(chunks)
        parts = list(map(self.known.get, distinct))
        missing = [k for k, p in enumerate(parts) if p is None]
        for k, p in zip(missing, self._learn([distinct[k] for k in missing])):
            parts[k] = p
        out, at, codes = [], 0, codes.tolist()
        for n in counts:
            out.append(b"".join([first, *map(parts.__getitem__, codes[at : at + n]), last]))
            at += n
        return out


def _encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def encode_texts(docs: DataFrame, model_path: str, begin: bool = True, end: bool = True) -> DataFrame:
    """(doc_id, ids): the ids of every text as little-endian unsigned 32-bit numbers, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model_path)
        for part, texts in slices(batches, "text"):
            found = encoder.encode(texts, begin, end)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, text): ``encoded`` with the text that the ids stand for; NULL ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _encoder(model_path).model
        for batch in batches:
            texts = [model.decode(np.frombuffer(i or b"", "<u4").tolist()) for i in batch.column("ids").to_pylist()]
            texts = pa.array([t or "" for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), texts], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")
