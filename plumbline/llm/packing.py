"""Best-fit packing after a reduction by dominance.

Documents become token ids with an end id; only longer ones are cut, into pieces of the
full length. Pieces of one length are alike, so the packing problem is the count of pieces
of each length: at most ``capacity`` numbers, however many documents there are. On these
counts the reduction (after Martello and Toth) walks lengths from the longest down and fixes
for good every sequence that dominates all others with its longest piece: a piece nothing
fits to; a pair when no third piece fits, when it is exactly full, or when its partner is
at least as long as any fitting pair; and an exactly full triple. The rest is packed best
fit, longest first, many equal sequences at a time.

The result is a plan of runs: pieces number low..high of a length go into a range of
sequences at a fixed offset. Its size depends on the capacity alone, so it is handed to
all tasks. Pieces are numbered within their length by salted windows with the
counts before each salt added, so a length that holds half of all pieces is no bottleneck.

Cases: a NULL or empty text is one piece that holds the end id alone. Equal lengths are
interchangeable; repeated rows are packed each. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .words import numbered, slices

CAPACITY = 2048
END_ID = 0
SALTS = 256
CACHED_WORDS = 900_000

_tokenizers: dict = {}


class WordTokenizer:
    """Token ids of texts, each distinct word tokenized once.

    Right for tokenizers that split at white space first, drop it, lower ASCII letters, and
    treat letters and the punctuation behind them alone. Added tokens are looked for before that: a
    text that may hold one is tokenized whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.inner.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.ends = dict(zip(".,", self._encoded([".", ","])))

    def _encoded(self, words: list[str]) -> list[bytes]:
        found = self.inner.encode_batch_fast(words, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of words not known yet; a word with a full stop or comma behind is its letters and that."""
        known, ends = self.known, self.ends
        stems = [w[:-1] if w[-1:] in ends and w[:-1].isalpha() else w for w in words]
        new = list({s for s in stems if s not in known})
        found = dict(zip(new, self._encoded(new)))
        if len(known) < CACHED_WORDS:
            known.update(found)
            found = known
        out = [
            (found[s] if s in found else known[s]) + (b"" if len(s) == len(w) else ends[w[-1]]) for s, w in zip(stems, words)
        ]
        if found is known:
            known.update(zip(words, out))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other and the number of ids of each text."""
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            low = text.lower()
            if any(a in low for a in self.added):
                words.append(text)
                counts[i] = 1
                continue
            if text.isascii() or "\u03a3" not in text and is_normalized("NFC", text):
                text = low  # as the tokenizer will, but for the final sigma
            found = text.replace("\n", " ").replace("\t", " ").split(" ")
            words += found
            counts[i] = len(found)
        codes, distinct = numbered(words)
        parts = list(map(self.known.get, distinct))
        if None in parts:
            at = [k for k, p in enumerate(parts) if p is None]
            for k, p in zip(at, self._learn([distinct[k] for k in at])):
                parts[k] = p
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        pool = np.frombuffer(b"".join(parts), np.uint32)
        first = np.cumsum(sizes) - sizes
        size = sizes[codes]
        ends = np.cumsum(size)
        ids = pool[np.repeat(first[codes] - (ends - size), size) + np.arange(size.sum())]
        return ids, np.add.reduceat(size, np.cumsum(counts) - counts) if len(counts) else counts


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def token_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, digest: bool = False
) -> DataFrame:
    """doc_id, piece, start, length and token ids of every piece of every document; with
    ``digest``, a CRC-32 of the ids in place of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        for part, texts in slices(batches, "text"):
            flat, counts = tokenizer.encode(texts)
            # The end id goes behind the ids of each text.
            flat = np.insert(flat, np.cumsum(counts), np.uint32(end_id))
            counts = counts + 1
            pieces = -(-counts // capacity)
            owner = np.repeat(np.arange(len(texts)), pieces)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(counts[owner] - start, capacity)
            edges = np.concatenate([[0], np.cumsum(length)])
            if digest:
                raw = flat.astype("<u4", copy=False)
                last = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(edges[:-1], edges[1:])], pa.int64())
            else:
                last = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(owner)),
                    pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), last,
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32" if digest else "ids"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "ids_crc32 long" if digest else "ids array<int>"
    return rows.mapInArrow(run, f"doc_id long, piece int, start long, length long, {kind}")


def _sum_of_smallest(count: np.ndarray, n: int) -> int | None:
    """Total length of the ``n`` shortest pieces, or None if there are fewer."""
    total = 0
    for size in np.flatnonzero(count):
        take = min(n, int(count[size]))
        total, n = total + int(size) * take, n - take
        if n == 0:
            return total
    return None


def _best_pair(count: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two pieces that fill ``room`` best: the longer first."""
    sizes = np.flatnonzero(count[: room + 1])
    best, low, high = None, 0, len(sizes) - 1
    while low <= high:
        total = int(sizes[low] + sizes[high])
        if total > room or (low == high and count[sizes[low]] < 2):
            high -= 1
            continue
        if best is None or total > sum(best):
            best = (int(sizes[high]), int(sizes[low]))
        low += 1
    return best


def reduce_by_dominance(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fixes dominating sequences and takes their pieces from ``count``: [(lengths, how many)]."""
    fixed = []

    def fix(*sizes: int) -> None:
        n = min(int(count[s]) // sizes.count(s) for s in sizes)
        for s in sizes:
            count[s] -= n
        fixed.append((sizes, n))

    for size in range(capacity, 0, -1):
        while count[size]:
            room = capacity - size
            count[size] -= 1  # the others, without this piece
            partners = np.flatnonzero(count[: room + 1])
            two, three = (_sum_of_smallest(count, n) for n in (2, 3))
            two_fit = two is not None and two <= room
            three_fit = three is not None and three <= room
            pair = _best_pair(count, room) if two_fit and not three_fit else None
            count[size] += 1
            partner = int(partners[-1]) if len(partners) else 0
            if not len(partners):
                fix(size)
            elif partner == room or not two_fit or pair and partner >= sum(pair):
                fix(size, partner)
            elif pair and pair[0] == partner and not _two_between(count, pair, room):
                fix(size, *pair)
            else:
                break
    return [(sizes, n) for sizes, n in fixed if n]


def _two_between(count: np.ndarray, pair: tuple[int, int], room: int) -> bool:
    """Whether two pieces of lengths between those of the pair fit too: of the other pairs,
    only such a one is not matched piece by piece."""
    middle = count.copy()
    middle[: pair[1] + 1] = 0
    middle[pair[0] :] = 0
    total = _sum_of_smallest(middle, 2)
    return total is not None and total <= room


class _Open:
    """Equal sequences: how many, the first one's number, the room left."""

    __slots__ = ("count", "first", "room", "used")

    def __init__(self, first: int, count: int, used: int, capacity: int):
        self.first, self.count, self.used, self.room = first, count, used, capacity - used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Runs of a packing: pieces number low..high-1 of a length go ``per`` to a sequence, from
    ``first`` on, at ``offset`` and behind it."""
    count = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        count[size] = n
    rank = np.zeros(capacity + 1, np.int64)  # pieces of each length that have a place
    runs: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0

    def put(size: int, first: int, how_many: int, offset: int, per: int) -> None:
        low = int(rank[size])
        rank[size] += how_many * per
        runs.append((size, low, int(rank[size]), first, per, offset))

    for sizes, n in reduce_by_dominance(count, capacity):
        offset = 0
        for size in sizes:
            put(size, sequences, n, offset, 1)
            offset += size
        sequences += n

    by_room: dict[int, list[_Open]] = {}
    rooms: list[int] = []  # the keys of by_room in order

    def store(group: _Open) -> None:
        if group.count and group.room:
            if group.room not in by_room:
                by_room[group.room] = []
                insort(rooms, group.room)
            by_room[group.room].append(group)

    def fill(group: _Open, size: int, left: int) -> int:
        """Best fit puts equal pieces into one sequence until it is full, then into the next."""
        per = min(group.room // size, left)
        whole = min(group.count, left // per)
        put(size, group.first, whole, group.used, per)
        store(_Open(group.first, whole, group.used + per * size, capacity))
        first, rest, left = group.first + whole, group.count - whole, left - whole * per
        if rest and left:  # fewer are left than the next sequence takes
            put(size, first, 1, group.used, left)
            store(_Open(first, 1, group.used + left * size, capacity))
            first, rest, left = first + 1, rest - 1, 0
        store(_Open(first, rest, group.used, capacity))
        return left

    for size in range(capacity, 0, -1):
        left = int(count[size])
        while left:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                groups = by_room[rooms[at]]
                group = groups.pop()
                if not groups:
                    del by_room[rooms.pop(at)]
            else:
                group = _Open(sequences, -(-left // (capacity // size)), 0, capacity)
                sequences += group.count
            left = fill(group, size, left)
    return pd.DataFrame(runs, columns=["length", "low", "high", "first", "per", "offset"]).astype(np.int64)


def _numbered(pieces: DataFrame) -> DataFrame:
    """The pieces with a number from 0 within their length, in ``rank``."""
    names = pieces.columns
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*names), F.lit(SALTS)).cast("int"))
    sums = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))  # at most capacity * SALTS rows
    before = sums.select(
        "length",
        "salt",
        (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"),
    )
    order = Window.partitionBy("length", "salt").orderBy(*names)
    return (
        salted.withColumn("own", F.row_number().over(order) - 1)
        .join(F.broadcast(before), ["length", "salt"])
        .select(*names, (F.col("own") + F.col("before")).alias("rank"))
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (any columns with ``length`` from 1 to the capacity) with sequence_id and offset.

    The input is read twice: pass a written table, without wide columns.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = plan(histogram, capacity).sort_values(["length", "low"], ignore_index=True)
    runs = pieces.sparkSession.sparkContext.broadcast(runs)
    names = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        stride = int(table["high"].max()) + 1 if len(table) else 1
        keys = (table["length"] * stride + table["low"]).to_numpy()
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, length * stride + rank, "right") - 1
            low, first, per, offset = (table[c].to_numpy()[at] for c in ("low", "first", "per", "offset"))
            inner = rank - low
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in names),
                    pa.array(first + inner // per), pa.array(offset + inner % per * length),
                ],
                [*names, "sequence_id", "offset"],
            )

    return _numbered(pieces).mapInArrow(place, schema + ", sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its place, its ids given by their CRC-32."""
    pieces = materialize(token_pieces(docs, tokenizer_path, capacity, digest=True))
    return pack(pieces, capacity)


def sequences(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, doc_ids and token ids in order.

    A sequence is at most ``capacity`` ids, so no group grows with the data.
    """
    pieces = materialize(token_pieces(docs, tokenizer_path, capacity))
    placed = pack(pieces, capacity)
    groups = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("x"))
    return groups.select(
        "sequence_id",
        F.transform("x", lambda x: x["doc_id"]).alias("doc_ids"),
        F.flatten(F.transform("x", lambda x: x["ids"])).alias("ids"),
    )
