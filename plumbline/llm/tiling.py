"""Benchmark decontamination by greedy string tiling.

Runs of five words, hashed by rolling (Karp-Rabin) hashes, are the seeds: the seeds of the
benchmark items are one sorted array that every task looks its documents up in. For a
document and an item that share seeds, seeds in a row on one diagonal are joined to
maximal matches, checked word by word. The longest match is marked first; what is left of
the others between marked words competes again, until no unmarked match of five words is
left. The share of the item's words that tiles cover is the coverage, whatever the order of
the tiles, so reordered passages count in full.

The benchmark is cut into blocks of a bounded number of words; each block is one pass over
the documents. Documents never move.

Cases: words are runs of letters and digits, in lower case. NULL and empty texts and items
hold no words; an item of fewer than five words is one seed of all its words, and covered where
they stand in a row. Of equally long matches the one at the smaller place in the document, then in
the item, is marked first. A very long text is searched alone in one task. Other columns are
kept or not read, whatever their names. Items repeated in the
benchmark are reported each. Repeated document rows are reported each. Empty tables on
either side give no hits and drop nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import rolled, runs, slices, split_words, word_hashes

SEED_WORDS = 5
COVERAGE = 0.5
BLOCK_WORDS = 1_000_000  # words of the benchmark that every task holds at once, some 30 MB
_BITS = 22


class Seeds:
    """The items of one block with their seeds, in sorted order."""

    def __init__(self, ids: list, texts: list[str]):
        words, counts = split_words(texts, letters=True)
        self.ids, self.hashes = ids, word_hashes(words)
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        total = rolled(self.hashes, SEED_WORDS)
        item = np.repeat(np.arange(len(counts)), counts)
        place = np.flatnonzero(item[: len(total)] == item[SEED_WORDS - 1 :][: len(total)])
        order = np.argsort(total[place], kind="stable")
        self.seeds, self.places = total[place][order], place[order]
        self.item = item
        self.table = np.zeros(1 << _BITS, bool)
        self.table[(self.seeds >> np.uint64(64 - _BITS)).astype(np.int64)] = True

        # Items too short for a seed: by their number of words, the hash of all their words and the items.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, SEED_WORDS):
            few = np.flatnonzero(counts == n)
            if len(few):
                values = rolled(self.hashes, n)[self.starts[few]]
                order = np.argsort(values, kind="stable")
                self.short[n] = values[order], few[order]

    def whole(self, hashes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text number, item, place, words) of the first place of each short item that a text holds."""
        for n, (values, items) in self.short.items():
            total, text = runs(hashes, counts, n)
            low, high = (np.searchsorted(values, total, side) for side in ("left", "right"))
            at = np.flatnonzero(high > low)
            shift = np.cumsum(np.minimum(counts, n - 1)) - np.minimum(counts, n - 1)
            starts = np.cumsum(counts) - counts
            seen = set()
            for k in at:
                number = int(text[k])
                for item in items[low[k] : high[k]].tolist():
                    if (number, item) not in seen:
                        seen.add((number, item))
                        yield number, item, int(k - starts[number] + shift[number]), n

    def words_of(self, item: int) -> np.ndarray:
        return self.hashes[self.starts[item] : self.ends[item]]

    def candidates(self, total: np.ndarray) -> np.ndarray:
        """Places in ``total`` whose value is a seed."""
        if not len(self.seeds):
            return np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.table[(total >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(maybe):
            return maybe
        at = np.minimum(np.searchsorted(self.seeds, total[maybe]), len(self.seeds) - 1)
        return maybe[self.seeds[at] == total[maybe]]

    def pairs(self, total: np.ndarray, places: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By item: places in the document and in the item that begin with one seed."""
        low = np.searchsorted(self.seeds, total[places], "left")
        high = np.searchsorted(self.seeds, total[places], "right")
        n = high - low
        doc = np.repeat(places, n)
        inner = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        own = self.places[np.repeat(low, n) + inner]
        item = self.item[own]
        order = np.argsort(item, kind="stable")
        doc, own, item = doc[order], own[order], item[order]
        edges = np.flatnonzero(np.diff(item, prepend=-1))
        return {
            int(item[a]): (doc[a:b], own[a:b] - self.starts[item[a]]) for a, b in zip(edges, [*edges[1:], len(item)])
        }


def matches(doc: np.ndarray, item: np.ndarray, doc_at: np.ndarray, item_at: np.ndarray) -> list[tuple[int, int, int]]:
    """Maximal matches (length, place in the document, place in the item) from seed places."""
    same = np.ones(len(doc_at), bool)
    for k in range(SEED_WORDS):
        same &= doc[doc_at + k] == item[item_at + k]
    doc_at, item_at = doc_at[same], item_at[same]
    if not len(doc_at):
        return []
    order = np.lexsort((doc_at, doc_at - item_at))
    doc_at, item_at = doc_at[order], item_at[order]
    diagonal = doc_at - item_at
    begins = np.ones(len(doc_at), bool)
    begins[1:] = (diagonal[1:] != diagonal[:-1]) | (doc_at[1:] != doc_at[:-1] + 1)
    starts = np.flatnonzero(begins)
    lengths = np.diff(starts, append=len(doc_at)) + SEED_WORDS - 1
    return list(zip(lengths.tolist(), doc_at[starts].tolist(), item_at[starts].tolist()))


def tile(found: list[tuple[int, int, int]], item_words: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the document, place in the item, length), longest first, then by place."""
    heap = [(-n, d, i) for n, d, i in found]
    heapq.heapify(heap)
    doc_marked: set[int] = set()
    item_marked = bytearray(item_words)
    tiles = []
    while heap:
        n, d, i = heapq.heappop(heap)
        n = -n
        free = [not item_marked[i + k] and d + k not in doc_marked for k in range(n)]
        if all(free):
            tiles.append((d, i, n))
            item_marked[i : i + n] = b"\1" * n
            doc_marked.update(range(d, d + n))
            if all(item_marked):
                break
            continue
        # What is left between marked words competes with its own length.
        k = 0
        while k < n:
            if not free[k]:
                k += 1
                continue
            end = k
            while end < n and free[end]:
                end += 1
            if end - k >= SEED_WORDS:
                heapq.heappush(heap, (k - end, d + k, i + k))
            k = end
    return tiles


def _tiled(seeds: Seeds, texts: list[str], coverage: float) -> Iterator[tuple[int, int, list, float]]:
    """(text number, item number, tiles, coverage) of all pairs that reach ``coverage``."""
    words, counts = split_words(texts, letters=True)
    hashes = word_hashes(words)
    for number, item, place, n in seeds.whole(hashes, counts):
        yield number, item, [(place, 0, n)], 1.0
    total, text = runs(hashes, counts, SEED_WORDS)
    hits = seeds.candidates(total)
    owner = text[hits]
    starts = np.cumsum(counts) - counts
    # Place of a seed among the words: runs of earlier texts are fewer than their words.
    shift = np.cumsum(np.minimum(counts, SEED_WORDS - 1)) - np.minimum(counts, SEED_WORDS - 1)
    edges = np.flatnonzero(np.diff(owner, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(owner)]):
        number = int(owner[a])
        doc = hashes[starts[number] : starts[number] + counts[number]]
        offset = starts[number] - shift[number]
        for item, (doc_at, item_at) in seeds.pairs(total, hits[a:b]).items():
            own = seeds.words_of(item)
            tiles = tile(matches(doc, own, doc_at - offset, item_at), len(own))
            share = sum(n for *_, n in tiles) / len(own)
            if share >= coverage:
                yield number, item, tiles, share


def _blocks(benchmark: DataFrame, block_words: int) -> tuple[DataFrame, int]:
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    letters = rows.agg(F.sum(F.length("text")).alias("n"), F.max(F.length("text")).alias("most")).first()
    # A word takes two characters or more with the space behind it.
    n = max(1, -(-((letters["n"] or 0) + 1) // (2 * block_words)))
    return rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), n


def _each_block(benchmark: DataFrame, block_words: int) -> Iterator:
    rows, n = _blocks(benchmark, block_words)
    spark = benchmark.sparkSession
    for block in range(n):
        items = rows.where(F.col("block") == block).select("item_id", "text").collect()  # a bounded number of words
        yield spark.sparkContext.broadcast(([r["item_id"] for r in items], [r["text"] for r in items]))


_loaded: dict = {}


def _seeds(block) -> Seeds:
    """The block's seeds, built once in each worker."""
    if block.value is not _loaded.get("value"):
        _loaded.update(value=block.value, seeds=Seeds(*block.value))
    return _loaded["seeds"]


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, item_words, covered, coverage and tiles (place in the document, place in
    the item, length, in words) of every document that covers an item."""
    schema = (
        "doc_id long, item_id long, item_words long, covered long, coverage double, "
        "tiles array<struct<doc_start:long,item_start:long,length:long>>"
    )
    kinds = pa.schema(
        [
            ("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int64()), ("covered", pa.int64()),
            ("coverage", pa.float64()),
            ("tiles", pa.list_(pa.struct([("doc_start", pa.int64()), ("item_start", pa.int64()), ("length", pa.int64())]))),
        ]
    )

    def on(block) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = _seeds(block)
            for part, texts in slices(batches, "text"):
                ids = part.column("doc_id").to_pylist()
                out = [
                    {
                        "doc_id": ids[number], "item_id": seeds.ids[item], "item_words": len(seeds.words_of(item)),
                        "covered": sum(n for *_, n in tiles), "coverage": share,
                        "tiles": [{"doc_start": d, "item_start": i, "length": n} for d, i, n in sorted(tiles)],
                    }
                    for number, item, tiles, share in _tiled(seeds, texts, coverage)
                ]
                if out:
                    yield pa.RecordBatch.from_pylist(out, kinds)

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = [rows.mapInArrow(on(block), schema) for block in _each_block(benchmark, block_words)]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionAll(part)
    return result


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The documents that cover no item, with all their columns."""

    def on(block, column: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = _seeds(block)
            for batch in batches:
                kept = np.ones(batch.num_rows, bool)
                first = 0
                text = pa.RecordBatch.from_arrays([batch.column(column)], ["text"])
                for part, texts in slices([text], "text"):
                    for number, *_ in _tiled(seeds, texts, coverage):
                        kept[first + number] = False
                    first += part.num_rows
                yield batch.filter(pa.array(kept))

        return run

    names = docs.columns
    for block in _each_block(benchmark, block_words):
        docs = docs.mapInArrow(on(block, names.index("text")), docs.schema)
    return docs


