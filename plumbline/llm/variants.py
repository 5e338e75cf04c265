"""Spelling variants: words one edit apart, found by dense tiles of common prefixes and suffixes.

Words are counted once for the corpus; all that follows works on distinct words. Two words are
one inserted, deleted or replaced code point apart exactly if their common prefix and common
suffix together reach the longer length minus one. So one of the two reaches half of it, and
near words always meet in a block of words with that half in common. A block is laid out as
padded matrices of code points, aligned left and right, and its word pairs are compared a
tile at a time: the first unequal column from either side gives both lengths.

A block of more than BLOCK words (many words may share their first letters) is dealt anew by the
rest of the word without one position: a group of it holds at most one word for each
letter and position. No pair is lost and no task gets a block that grows with the vocabulary.

What moves: one partial count of a word for each slice of text, then distinct words, four rows
each. The form of a word is its most frequent near word if that is frequent enough; as each form
is several times as frequent as its word, chains are short, and they are followed by joins
that double the steps of each round.

Cases: NULL and empty texts have no words; repeated rows count each; a run of letters of any
length is one word. A NULL doc_id is an empty text where words are altered by it. Ties between forms go to the
smallest word in code-point order. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .words import slices

LEAST_LETTERS = 6
LEAST_TIMES = 5
MORE = 5  # times as frequent as a word must its form be
BLOCK = 1024  # words that are compared as one block
CELLS = 4_000_000  # matrix cells that are compared at once

_RUN = re.compile(rb"[a-z\xc0-\xff]+")
_RADIX = 0x9E3779B97F4A7C15 | 1
_WORD_BITS = (1 << 64) - 1


def thinned(doc_id: int | None, one_in: int = 199) -> Callable[[bytes], bytes]:
    """A change of a document's words (in Latin-1): one in ``one_in`` loses a code point, by a checksum."""
    seed = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)

    def change(word: bytes) -> bytes:
        own = word if word.isascii() else word.decode("latin-1").encode("utf-8")
        h = zlib.crc32(own, seed)
        if h % one_in:
            return word
        k = h % len(word)
        return word[:k] + word[k + 1 :]

    return change


def count_words(
    docs: DataFrame,
    alter: Callable[[int | None], Callable[[bytes], bytes]] | None = None,
    letters: int = LEAST_LETTERS,
    times: int = LEAST_TIMES,
) -> DataFrame:
    """(word, n): runs of Latin letters, A-Z in lower case, with their number in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            total: Counter = Counter()
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts):
                # Every letter of a run is one byte of Latin-1, and only A-Z have a lower case there.
                found = Counter(_RUN.findall(text.encode("latin-1", "replace").lower()))
                if alter:
                    change = alter(doc_id)
                    for word, n in found.items():
                        new = change(word)
                        if len(new) >= letters:
                            total[new] += n
                else:
                    for word, n in found.items():
                        if len(word) >= letters:
                            total[word] += n
            words = pa.array([w.decode("latin-1") for w in total], pa.string())
            yield pa.RecordBatch.from_arrays([words, pa.array(total.values(), pa.int64())], ["word", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def _keyed(words: DataFrame) -> DataFrame:
    """A row for each block of a word: once as the longer word of a pair or as long, once as the shorter."""
    half = lambda most: F.floor(most / 2).cast("int")
    blocks = []
    for more in (0, 1):
        most = F.length("word") + more
        first = F.substring(F.col("word"), F.lit(1), half(most))
        last = F.substring(F.col("word"), F.length("word") - half(most) + 1, half(most))
        for side, part in ((0, first), (1, last)):
            key = F.xxhash64(most, F.lit(side), part)
            blocks.append(F.struct(key.alias("key"), most.alias("most"), F.lit(side).alias("side")))
    return words.select("word", "n", F.explode(F.array(*blocks)).alias("b")).select("b.*", "word", "n")


def _without_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks dealt anew: by the word without one position beyond the common half.

    ``kind``: 1 for words of one length (the position counts), 2 for a longer and a shorter one.
    """
    for batch in batches:
        rows, keys, kinds = [], [], []
        columns = (batch.column(c).to_pylist() for c in ("key", "most", "side", "word"))
        for i, (key, most, side, word) in enumerate(zip(*columns)):
            if len(word) < most:
                rows.append(i)
                keys.append(_mixed(key, 2, _ends(word)[0][-1]))
                kinds.append(2)
                continue
            before, after = _ends(word)
            half = most // 2
            without = set()
            for k in range(half, most) if side == 0 else range(most - half):
                # The hash of the word without position k.
                rest = (before[k] * pow(_RADIX, most - k - 1, 1 << 64) + after[k + 1]) & _WORD_BITS
                rows.append(i)
                keys.append(_mixed(key, 1, rest, k))
                kinds.append(1)
                without.add(rest)
            for rest in without:
                rows.append(i)
                keys.append(_mixed(key, 2, rest))
                kinds.append(2)
        moved = batch.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), *(moved.column(c) for c in ("most", "side", "word", "n")), pa.array(kinds, pa.int32())],
            ["key", "most", "side", "word", "n", "kind"],
        )


def _ends(word: str) -> tuple[list[int], list[int]]:
    """Polynomial hashes of all prefixes and of all suffixes by their start."""
    before, after, power = [0], [0], 1
    for c in word:
        before.append((before[-1] * _RADIX + ord(c)) & _WORD_BITS)
    for c in reversed(word):
        after.append((ord(c) * power + after[-1]) & _WORD_BITS)
        power = power * _RADIX & _WORD_BITS
    return before, after[::-1]


def _mixed(*values: int) -> int:
    out = 0
    for v in values:
        out = ((out ^ (v & _WORD_BITS)) * 0xBF58476D1CE4E5B9) & _WORD_BITS
        out ^= out >> 31
    return out - (1 << 64) if out >> 63 else out


def _matrices(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, aligned left and right, padded with 0."""
    left = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    at = np.arange(width) - (width - lengths)[:, None]
    right = np.where(at >= 0, np.take_along_axis(left, np.maximum(at, 0), 1), 0)
    small = np.uint8 if left.max(initial=0) < 256 else np.uint32
    return left.astype(small), right.astype(small)


def _tiles(keys: np.ndarray, most: int, side: np.ndarray, kind: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, row) of near words in blocks of one ``most``; rows of a block stand together."""
    left, right = _matrices(words, most)
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
    end = ends[np.searchsorted(ends, np.arange(len(keys)), "right")]
    partners = end - np.arange(len(keys)) - 1
    at = np.cumsum(partners) * most // CELLS
    found_a, found_b = [], []
    cuts = np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(keys))
    for low, high in zip(cuts[:-1], cuts[1:]):
        n = partners[low:high]
        a = np.repeat(np.arange(low, high), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        one = length[a] == length[b]
        fit = (np.maximum(length[a], length[b]) == most) & ((kind[a] == 0) | (one == (kind[a] == 1)))
        a, b = a[fit], b[fit]
        if not len(a):
            continue
        first = np.argmax(left[a] != left[b], axis=1)  # words are distinct, so there is one
        last = np.argmax((right[a] != right[b])[:, ::-1], axis=1)
        half = most // 2
        near = (first + last >= most - 1) & np.where(side[a] == 0, first >= half, (last >= half) & (first < half))
        found_a.append(a[near])
        found_b.append(b[near])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by (most, key) to pairs of near words, in both directions."""
    rest: pa.Table | None = None

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        most, keys = table.column("most").to_numpy(), table.column("key").to_numpy()
        # Whole blocks of one length, as many as fit into matrices of a bounded size.
        border = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
        block = np.searchsorted(border, np.arange(len(keys)), "right")
        room = (np.append(0, border)[block] * most.astype(np.int64)) // (4 * CELLS)
        new = (np.diff(most, prepend=-1) != 0) | (np.diff(room, prepend=-1) != 0)
        cuts = np.append(np.flatnonzero(new), len(most))
        for low, high in zip(cuts[:-1], cuts[1:]):
            part = table.slice(low, high - low).combine_chunks()
            word, n = part.column("word").combine_chunks(), part.column("n").combine_chunks()
            key, side, kind = (part.column(c).to_numpy() for c in ("key", "side", "kind"))
            a, b = _tiles(key, int(most[low]), side, kind, word.to_pylist())
            a, b = pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))
            yield pa.RecordBatch.from_arrays([word.take(a), word.take(b), n.take(b)], ["word", "near", "near_n"])

    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        key = table.column("key").to_numpy()
        last = np.flatnonzero(key != key[-1])
        cut = int(last[-1]) + 1 if len(last) else 0  # the last block may go on in the next batch
        rest = table.slice(cut)
        yield from pairs(table.slice(0, cut))
    if rest is not None:
        yield from pairs(rest)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n): every pair of distinct words one edit apart, both ways, from (word, n)."""
    keyed = _keyed(words.select("word", "n"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    blocks = materialize(keyed.join(sizes.where("size > 1"), "key").withColumn("kind", F.lit(0)))
    names = ["key", "most", "side", "word", "n", "kind"]
    rows = blocks.where(F.col("size") <= block).select(names)
    large = blocks.where(F.col("size") > block).select("key", "most", "side", "word", "n")
    if not large.isEmpty():
        dealt = large.mapInArrow(_without_one, "key long, most int, side int, word string, n long, kind int")
        rows = rows.unionByName(dealt.select(names))
    dealt = rows.repartition("key").sortWithinPartitions("most", "key")
    return dealt.mapInArrow(_near, "word string, near string, near_n long")


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each word's chain of forms."""
    roots = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("up"))
        moved = materialize(roots.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), "up"))
        roots = moved.select("word", "root")
        if moved.where("up is not null").isEmpty():
            return roots


def group_variants(words: DataFrame, more: int = MORE, block: int = BLOCK) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of (word, n); words are distinct."""
    words = materialize(words.select("word", "n"))
    best = near_words(words, block).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    formed = F.when(-F.col("best.less") >= more * F.col("n"), F.col("best.near"))
    form_n = F.when(formed.isNotNull(), -F.col("best.less"))
    known = materialize(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), formed.alias("form"), form_n.alias("form_n")
        )
    )
    roots = followed(known.where("form is not null"))
    return known.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
