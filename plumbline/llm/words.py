"""Words and word runs of many texts as flat numpy arrays, for code inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

SLICE_CHARS = 2_000_000  # text handled at once inside a task; a longer text is handled alone
_RADIX = np.uint64(0x9E3779B97F4A7C15 | 1)
_LETTERS = re.compile(r"\w+")


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit function of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches with a bounded amount of text, NULL as empty."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes, dtype=np.int64) // SLICE_CHARS
        edges = np.flatnonzero(np.diff(block, prepend=-1))
        for a, b in zip(edges, [*edges[1:], batch.num_rows]):
            part = batch.slice(a, b - a)
            yield part, [t or "" for t in part.column(column).to_pylist()]


def split_words(texts: list[str], letters: bool = False, lower: bool = True) -> tuple[list[str], np.ndarray]:
    """All words one after the other and the number of words of each text.

    Words are split at white space, or with ``letters`` are runs of letters and digits.
    """
    words: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        text = text.lower() if lower else text
        found = _LETTERS.findall(text) if letters else text.split()
        words += found
        counts[i] = len(found)
    return words, counts


def numbered(words: list[str]) -> tuple[np.ndarray, list[str]]:
    """The number of each word in order of first occurrence, and the distinct words.

    Unlike with pandas, words may hold NUL characters.
    """
    found = pa.array(words, pa.string()).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.to_pylist()


def word_hashes(words: list[str]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    values = np.empty(len(words), dtype=object)
    values[:] = words
    return pd.util.hash_array(values, categorize=False)


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """A rolling hash of every run of ``size`` words, without regard to text borders."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n].copy()
    for k in range(1, size):
        total *= _RADIX
        total += hashes[k : k + n]
    return mix(total)


def runs(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every run of ``size`` words within a text, and its text's number."""
    text = np.repeat(np.arange(len(counts)), counts)
    total = rolled(hashes, size)
    inside = text[: len(total)] == text[size - 1 :][: len(total)]
    return total[inside], text[: len(total)][inside]


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``size`` words; a text with fewer words is one run of all of them."""
    total, text = runs(hashes, counts, size)
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            starts = np.cumsum(counts)[short] - n
            value = hashes[starts].copy()
            for k in range(1, n):
                value = value * _RADIX + hashes[starts + k]
            total = np.concatenate([total, mix(value + np.uint64(n))])
            text = np.concatenate([text, short])
    return total, text


def bags(total: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) with the number of times, ordered by text and hash."""
    if not len(total):
        return text, total, np.zeros(0, np.int64)
    order = np.lexsort((total, text))
    total, text = total[order], text[order]
    first = np.ones(len(total), bool)
    first[1:] = (total[1:] != total[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(first)
    return text[starts], total[starts], np.diff(starts, append=len(total))
