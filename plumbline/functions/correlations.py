"""Pearson correlations of many column pairs in one pass, over pairwise complete rows.

Each task adds up, for all pairs at once, the products of its rows as blocks of one row of the
matrix each; blocks merge by addition in two levels, so no task holds more than a few hundred of
them. Only blocks are shuffled, never rows.

Values are centred and scaled per column first, so sums keep their digits. A pair whose value is
constant on its complete rows, or that meets an infinite value, has no correlation. Where a variance is
so small against its sum of squares that digits are lost, the engine's own aggregates are used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import batches

DIRECT_PAIRS = 36  # up to here one pass of the engine's aggregates serves all pairs
PAIRS_IN_STATE = 250_000  # pairs a task keeps sums for; more are further passes
CELLS = 4_000_000  # values a task looks at together
MERGE_GROUPS = 256  # groups of tasks whose blocks are merged before those of all tasks
LOST_DIGITS = 1e-9  # share of the squares below which a variance is recomputed

BLOCK = "left int, block binary"
# Where the least and where the greatest values begin in a state.
PAIR_KINDS = (7, 9)  # n, infinite, sums of x, y, xx, yy, xy; least x and y; greatest x and y
REACH_KINDS = (2, 3)  # n, sum; least; greatest
RESULT = "left int, right int, n bigint, r double, doubtful boolean"


def correlations(
    df: DataFrame, values: dict[str, Column], left: Sequence[str] | None = None
) -> list[tuple[str, str, int, float | None]]:
    """``(x, y, pairs, r)`` for each x of ``left`` (default: all) and y of ``values``, each pair once.

    ``values`` are doubles without NaN. The result has one row per pair of columns.
    """
    names = list(values)
    place = {c: i for i, c in enumerate(names)}
    lefts = [place[c] for c in (names if left is None else left)]
    seen = set(lefts)
    # Pairs within ``left`` are wanted once.
    pairs = [(i, j) for i in lefts for j in range(len(names)) if j not in seen or j >= i]
    if len(pairs) <= DIRECT_PAIRS:
        found = _direct(df, values, pairs)
    else:
        found = {}
        for group in batches(lefts, max(1, PAIRS_IN_STATE // len(names))):
            found |= _blocks(df, values, group)
    return [(names[i], names[j], *found[i, j]) for i, j in pairs]


def safe_corr(x: Column, y: Column) -> Column:
    """The engine's aggregates; NULL where a side does not vary, which their rounding alone would hide."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def _direct(df: DataFrame, values: dict[str, Column], pairs: Sequence[tuple[int, int]]) -> dict:
    columns, found = list(values.values()), {}
    for group in batches(pairs, max(1, DIRECT_PAIRS)):
        aggs = []
        for k, (i, j) in enumerate(group):
            x, y = columns[i], columns[j]
            aggs += [F.count_if(x.isNotNull() & y.isNotNull()).alias(f"n{k}"), safe_corr(x, y).alias(f"r{k}")]
        row = df.agg(*aggs).first()
        for k, pair in enumerate(group):
            r = row[f"r{k}"]
            found[pair] = (row[f"n{k}"], None if r is None or r != r else r)
    return found


def _blocks(df: DataFrame, values: dict[str, Column], lefts: list[int]) -> dict:
    names = [f"x{i}" for i in range(len(values))]
    rows = df.select(*[v.alias(n) for n, v in zip(names, values.values())])
    states = rows.mapInArrow(_summed(lefts, *_frame(rows, len(names))), BLOCK)
    merged = _pooled(states, len(names), PAIR_KINDS)
    found, doubtful = {}, []
    pairs = merged.mapInArrow(_read(len(names)), RESULT).toArrow()  # one row per pair of columns
    for i, j, n, r, lost in zip(*[pairs.column(c).to_pylist() for c in pairs.column_names]):
        found[i, j] = (n, r)
        if lost:
            doubtful.append((i, j))
    if not found:  # no rows at all
        return {(i, j): (0, None) for i in lefts for j in range(len(names))}
    return found | _direct(df, values, doubtful)


def _frame(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each column lies and how far it reaches; any values serve, good ones keep digits."""
    states = _pooled(rows.mapInArrow(_reach, BLOCK), width, REACH_KINDS).toArrow()
    if not states.num_rows:
        return np.zeros(width), np.ones(width)
    n, total, low, high = np.nan_to_num(_open(states.column("block")[0], width), posinf=np.inf, neginf=-np.inf)
    mean = total / np.maximum(n, 1)
    middle = np.where(np.isfinite(mean), np.clip(mean, low, high), low / 2 + high / 2)
    # Halves do not overflow.
    reach = np.maximum(high / 2 - middle / 2, middle / 2 - low / 2)
    return middle, np.where(reach > 0, reach, 1.0)


def _reach(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task that yields count, sum, least and greatest of the finite values of each column."""
    total = None
    for part in parts:
        for x in _cuts(part):
            x = np.where(np.isinf(x), np.nan, x)
            with np.errstate(over="ignore"):
                sums = [(~np.isnan(x)).sum(axis=0), np.nansum(x, axis=0)]
            state = np.stack([*sums, np.fmin.reduce(x, axis=0), np.fmax.reduce(x, axis=0)])
            total = state if total is None else _added(total, state, REACH_KINDS)
    if total is not None:
        yield _block(0, total)


def _cuts(part: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The rows of a batch in pieces of bounded size, NaN for NULL."""
    step = max(1, CELLS // part.num_columns)
    for start in range(0, part.num_rows, step):
        cut = part.slice(start, step)
        yield np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in cut.columns])


def _pooled(states: DataFrame, width: int, kinds: tuple[int, int]) -> DataFrame:
    """One block per left column; those of a group of tasks are merged first."""
    part = F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("part")
    states = states.select("left", "block", part).groupBy("left", "part").applyInArrow(_merged(width, kinds), BLOCK)
    return states.groupBy("left").applyInArrow(_merged(width, kinds), BLOCK)


def _summed(lefts: list[int], centre: np.ndarray, scale: np.ndarray) -> Callable:
    """A task that yields one block per left column."""

    def extremes(x: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest of each column of ``x`` over the rows where each column of ``given`` is true."""
        low, high = np.full((2, x.shape[1], given.shape[1]), np.nan)
        whole = given.all(axis=0)
        if whole.any():
            low[:, whole], high[:, whole] = (f.reduce(x, axis=0)[:, None] for f in (np.fmin, np.fmax))
        for j in np.flatnonzero(~whole & given.any(axis=0)):
            some = x[given[:, j]]
            low[:, j], high[:, j] = np.fmin.reduce(some, axis=0), np.fmax.reduce(some, axis=0)
        return low, high

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts:
            for x in _cuts(part):
                there, endless = ~np.isnan(x), np.isinf(x)
                with np.errstate(invalid="ignore", over="ignore"):
                    z = np.where(there & ~endless, (x / 2 - centre / 2) / scale, 0.0)
                one, bad = there.astype(float), endless.astype(float)
                zl, ol, bl, xl = z[:, lefts], one[:, lefts], bad[:, lefts], x[:, lefts]
                x_low, x_high = extremes(xl, there)
                y_low, y_high = (e.T for e in extremes(x, there[:, lefts]))
                sums = [ol.T @ one, bl.T @ one + ol.T @ bad, zl.T @ one, ol.T @ z, (zl * zl).T @ one, ol.T @ (z * z), zl.T @ z]
                state = np.stack([*sums, x_low, y_low, x_high, y_high], axis=1)  # left, kind, right
                total = state if total is None else _added(total, state, PAIR_KINDS)
        if total is not None:
            for i, block in zip(lefts, total):  # one block at a time, so that batches stay small
                yield _block(i, block)

    return run


def _added(a: np.ndarray, b: np.ndarray, kinds: tuple[int, int]) -> np.ndarray:
    """Two states as one: sums, then least, then greatest values along the last axis but one."""
    parts = zip((np.add, np.fmin, np.fmax), np.split(a, kinds, axis=-2), np.split(b, kinds, axis=-2))
    return np.concatenate([f(x, y) for f, x, y in parts], axis=-2)


def _block(left: int, block: np.ndarray) -> pa.RecordBatch:
    data = [pa.array([left], pa.int32()), pa.array([block.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(data, ["left", "block"])


def _open(cell: pa.Scalar, width: int) -> np.ndarray:
    return np.frombuffer(cell.as_py(), dtype=float).reshape(-1, width)


def _merged(width: int, kinds: tuple[int, int]) -> Callable[[pa.Table], pa.Table]:
    def run(blocks: pa.Table) -> pa.Table:
        total = None
        for cell in blocks.column("block"):
            block = _open(cell, width)
            total = block if total is None else _added(total, block, kinds)
        return pa.Table.from_batches([_block(blocks.column("left")[0].as_py(), total)])

    return run


def _read(width: int) -> Callable:
    """Blocks as one row per pair of columns."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for left, cell in zip(part.column("left").to_pylist(), part.column("block")):
                n, endless, sx, sy, sxx, syy, sxy, x_low, y_low, x_high, y_high = _open(cell, width)
                with np.errstate(invalid="ignore", divide="ignore"):
                    cxx, cyy, cxy = sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n
                    r = np.clip(cxy / (np.sqrt(cxx) * np.sqrt(cyy)), -1.0, 1.0)
                    known = (n > 1) & (endless == 0) & (x_low < x_high) & (y_low < y_high)
                    sharp = (cxx > LOST_DIGITS * sxx) & (cyy > LOST_DIGITS * syy)
                data = [
                    pa.array(np.full(width, left, np.int32)),
                    pa.array(np.arange(width, dtype=np.int32)),
                    pa.array(n.astype(np.int64)),
                    pa.array(r, mask=~(known & sharp)),
                    pa.array(known & ~sharp),
                ]
                yield pa.RecordBatch.from_arrays(data, ["left", "right", "n", "r", "doubtful"])

    return run
