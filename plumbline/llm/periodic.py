"""Runs of repeating words, found online on the active diagonals of a text against itself.

A text is walked word by word. Lag p is active while each word equals the word p places before
it; the match length of an active lag grows with every such word, and when a word differs, the
diagonal ends: with a match of m words, words start..start + m + p - 1 have period p, and
the run is emitted at once if it is long enough.

Which earlier occurrences open a diagonal keeps it sparse. A run of at least four periods repeats
its first windows of up to two periods one period later. With K the power of two from p up to 2 p - 1, the
window of K words at the first matching word of such a run has its nearest earlier occurrence
exactly p words before, as a window of p words or more cannot equal itself at a smaller shift
inside the run without a smaller period. So lag p is opened only where the nearest earlier
occurrence of a window of K words lies more than K / 2 and at most K words back. Diagonals that
are opened otherwise would be multiples of a smaller period or too short; every run is opened at
its first match, so none is lost and each has its smallest period. Nearest occurrences of all
windows come from doubling: the window of 2 K words is the pair of its halves, and only windows that occur twice are
doubled. Time is n log n in the words of a text even if one word is all of it.

Cases: NULL and empty texts have no words and no runs, and their collapsed text is empty.
Repeated rows are searched each. A very long text is searched alone in one task. Of
runs with equal length/period the first counts, then the smaller period. Extra columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import numbered, slices

LEAST_WORDS = 6
LEAST_PERIODS = 4

_WORD = re.compile(r"[^\x20\x09-\x0D]+")

RUN = "struct<start:long,length:long,period:long>"


def _openings(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of the diagonals to open, ordered by place; equal codes are one word of one text."""
    n = len(codes)
    at, rank, width = np.arange(n), codes, 1
    places, lags = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    by_place = np.empty(n + 1, np.int64)
    while len(at):
        order = np.argsort(rank, kind="stable")
        place, value = at[order], rank[order]
        same = value[1:] == value[:-1]
        lag = np.diff(place)
        hit = same & (lag <= width) & (2 * lag > width)
        places.append(place[1:][hit])
        lags.append(lag[hit])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at, rank = at[twice], rank[twice]
        by_place.fill(-1)
        by_place[at] = rank
        # Windows across texts occur once: codes of two texts differ.
        second = by_place[np.minimum(at + width, n)]
        whole = second >= 0
        at, rank = at[whole], pd.factorize(rank[whole] * np.int64(n + 1) + second[whole])[0]
        width *= 2
    place, lag = np.concatenate(places), np.concatenate(lags)
    order = np.lexsort((lag, place))
    return place[order], lag[order]


def find_runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of word numbers below its length, as they end."""
    places, lags = (x.tolist() for x in _openings(codes))
    if not places:
        return []
    word = [*codes.tolist(), -1]
    active: dict[int, int] = {}  # lag: match length so far
    found, k, i = [], 0, 0
    while active or k < len(places):
        if not active:
            i = places[k]
        here = word[i]
        for p in list(active):
            if here == word[i - p]:
                active[p] += 1
                continue
            m = active.pop(p)
            if m + p >= max(LEAST_WORDS, LEAST_PERIODS * p):
                found.append((i - m - p, m + p, p))
        while k < len(places) and places[k] == i:
            active.setdefault(lags[k], 1)
            k += 1
        i += 1
    return found


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length/period; ``runs`` are ordered by start and period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches, "text"):
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = _WORD.findall(text)
            words += found
            counts[i] = len(found)
        owner = np.repeat(np.arange(len(texts)), counts)
        number = numbered(words)[0].astype(np.int64)
        codes = pd.factorize(owner * np.int64(len(words) + 1) + number)[0].astype(np.int64)
        first = np.cumsum(counts) - counts
        runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        keep = np.ones(len(words), bool)
        for start, length, period in find_runs(codes):
            text = int(owner[start])
            runs[text].append((start - int(first[text]), length, period))
            keep[start + period : start + length] = False
        collapsed = []
        for i, (a, n) in enumerate(zip(first.tolist(), counts.tolist())):
            own = words[a : a + n]
            if runs[i]:
                runs[i].sort(key=lambda r: (r[0], r[2]))
                own = [w for w, k in zip(own, keep[a : a + n].tolist()) if k]
            collapsed.append(" ".join(own))
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        row = lambda r: r and dict(zip(("start", "length", "period"), r))
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"), pa.array(counts), pa.array([[row(r) for r in rs] for rs in runs], pa.list_(kind)),
                pa.array([row(_best(rs)) for rs in runs], kind), pa.array(collapsed, pa.string()),
            ],
            ["doc_id", "n_words", "runs", "best", "collapsed"],
        )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), best and the text without what runs repeat."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_searched, f"doc_id long, n_words long, runs array<{RUN}>, best {RUN}, collapsed string")
