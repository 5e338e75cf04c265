"""Exact, linearly interpolated quantiles without a global sort.

A value->count map of a whole column does not fit one task at scale. Large columns
are therefore narrowed first: a mergeable sketch proposes a value bracket around the
wanted rank, a counting pass proves that the bracket holds the rank, and the rank is
read off the few values inside it. Every pass is a plain aggregation, so nothing but
sketches and counts is shuffled, whatever the size or skew of the column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (
    DIRECT_QUANTILE_ROWS,
    FINE_SKETCH_K,
    FINE_SKETCH_ROWS,
    SKETCH_K,
    WIDE_AGG_COLUMNS,
)
from .columns import batches

INF = float("inf")


@dataclass
class _Target:
    """One wanted rank of one column and the value bracket that holds it."""

    column: str
    prob: float
    position: float  # zero-based fractional rank
    low: float = -INF
    high: float = INF
    below: int = 0  # values under the bracket
    inside: int = 0  # values in the bracket, ends included
    between: int = 0  # values strictly between the ends
    tries: int = 0

    @property
    def first(self) -> int:
        return math.floor(self.position)

    @property
    def last(self) -> int:
        return math.ceil(self.position)

    def within(self) -> Column:
        return F.col(self.column).between(F.lit(self.low), F.lit(self.high))


def exact_quantiles(
    df: DataFrame,
    values: dict[str, Column],
    probs: Sequence[float],
    counts: dict[str, int] | None = None,
    direct_rows: int = DIRECT_QUANTILE_ROWS,
    sketch_k: int | None = None,
) -> dict[str, list[float | None]]:
    """Quantiles of each named expression; NULLs are ignored, no values give None.

    ``counts`` may pass non-null counts that are already known and saves one pass.
    """
    if not values:
        return {}
    names = {f"q{i}": name for i, name in enumerate(values)}
    work = df.select(*[values[name].cast("double").alias(q) for q, name in names.items()])
    if counts is None:
        known: dict[str, int] = {}
        for group in batches(names, WIDE_AGG_COLUMNS):
            known.update(work.agg(*[F.count(q).alias(q) for q in group]).first().asDict())
    else:
        known = {q: counts[name] for q, name in names.items()}

    found: dict[str, list[float | None]] = {
        names[q]: [None] * len(probs) for q in names if known[q] == 0
    }
    small = [q for q in names if 0 < known[q] <= direct_rows]
    for group in batches(small, WIDE_AGG_COLUMNS // 3):
        grid = F.array(*[F.lit(float(p)) for p in probs])
        row = work.agg(*[F.percentile(q, grid).alias(q) for q in group]).first()
        found.update({names[q]: list(row[q]) for q in group})

    targets = [
        _Target(q, p, (known[q] - 1) * p, inside=known[q], between=known[q])
        for q in names
        if known[q] > direct_rows
        for p in probs
    ]
    if targets:
        if sketch_k is None:
            large = max(known.values()) > FINE_SKETCH_ROWS
            sketch_k = FINE_SKETCH_K if large else SKETCH_K
        _narrow(work, targets, direct_rows, sketch_k)
        solved = _select(work, targets)
        for q in {t.column for t in targets}:
            found[names[q]] = [solved[(q, p)] for p in probs]
    return found


def _narrow(work: DataFrame, targets: list[_Target], limit: int, sketch_k: int) -> None:
    """Shrink brackets until few values lie strictly inside each of them."""
    margin = 4 * 2.296 / sketch_k**0.9021  # four times the sketch's rank error
    while True:
        wide = [t for t in targets if t.between > limit]
        if not wide:
            return
        for group in batches(wide, WIDE_AGG_COLUMNS):
            proposals = _propose(work, group, margin, sketch_k)
            checks = []
            for i, (low, high) in enumerate(proposals):
                x = F.col(group[i].column)
                checks += [
                    F.count_if(x < F.lit(low)).alias(f"b{i}"),
                    F.count_if(x <= F.lit(high)).alias(f"u{i}"),
                ]
            row = _evaluated(work, group).agg(*checks).first()
            crowded = []
            for i, (target, (low, high)) in enumerate(zip(group, proposals)):
                below, upto = row[f"b{i}"], row[f"u{i}"]
                target.tries += 1
                if below <= target.first and target.last < upto:
                    target.low, target.high, target.tries = low, high, 0
                    target.below, target.inside = below, upto - below
                    target.between = target.inside if low < high else 0
                    if target.between > limit:
                        crowded.append(target)
                elif target.tries > 20:
                    raise RuntimeError(f"no bracket found for quantile {target.prob}")
            if crowded:
                _discount_ends(work, crowded)


def _evaluated(work: DataFrame, targets: Sequence[_Target]) -> DataFrame:
    """The columns of the targets, each computed once a row, however often a pass names it.

    Conditions on what a generator returns stay behind it; otherwise a filter repeats the expression, which may
    read numbers from text, for every end of every bracket.
    """
    columns = list(dict.fromkeys(t.column for t in targets))
    return work.select(F.stack(F.lit(1), *columns).alias(*columns))


def _discount_ends(work: DataFrame, targets: list[_Target]) -> None:
    """A hot value at an end of a bracket is one value; count only what lies between."""
    row = work.agg(
        *[
            F.count_if((F.col(t.column) > F.lit(t.low)) & (F.col(t.column) < F.lit(t.high))).alias(f"s{i}")
            for i, t in enumerate(targets)
        ]
    ).first()
    for i, t in enumerate(targets):
        t.between = row[f"s{i}"]


def _propose(
    work: DataFrame, group: list[_Target], margin: float, sketch_k: int
) -> list[tuple[float, float]]:
    """Ask one sketch per open bracket for values just around the wanted rank."""
    open_brackets: dict[tuple, list[_Target]] = {}
    for t in group:
        open_brackets.setdefault((t.column, t.low, t.high), []).append(t)
    sketches, asked = [], {}
    for i, members in enumerate(open_brackets.values()):
        ranks = []
        for t in members:
            slack = margin * 2**t.tries
            asked[id(t)] = (i, len(ranks))
            ranks.append(min(1.0, max(0.0, (t.first - t.below) / t.inside - slack)))
            ranks.append(min(1.0, max(0.0, (t.last - t.below + 1) / t.inside + slack)))
        value = F.when(members[0].within(), F.col(members[0].column))
        sketches.append(
            F.kll_sketch_get_quantile_double(
                F.kll_sketch_agg_double(value, F.lit(sketch_k)),
                F.array(*[F.lit(r) for r in ranks]),
            ).alias(f"k{i}")
        )
    row = _evaluated(work, group).agg(*sketches).first()
    proposals = []
    for t in group:
        i, at = asked[id(t)]
        proposals.append((row[f"k{i}"][at], row[f"k{i}"][at + 1]))
    return proposals


def _select(work: DataFrame, targets: list[_Target]) -> dict[tuple[str, float], float]:
    """Read the two neighbouring order statistics of each target and interpolate."""
    solved = {(t.column, t.prob): t.low for t in targets if t.low == t.high}
    for group in batches([t for t in targets if t.low < t.high], WIDE_AGG_COLUMNS // 3):
        aggs = []
        for i, t in enumerate(group):
            for end, rank in (("lo", t.first), ("hi", t.last)):
                share = (rank - t.below + 0.5) / t.inside
                aggs.append(
                    F.expr(
                        f"percentile_disc({share!r}D) WITHIN GROUP (ORDER BY v{i})"
                    ).alias(f"{end}{i}")
                )
        narrowed = _evaluated(work, group).select(
            *[F.when(t.within(), F.col(t.column)).alias(f"v{i}") for i, t in enumerate(group)]
        ).filter(F.coalesce(*[f"v{i}" for i in range(len(group))]).isNotNull())
        row = narrowed.agg(*aggs).first()
        for i, t in enumerate(group):
            low, high = row[f"lo{i}"], row[f"hi{i}"]
            up = t.position - t.first
            solved[(t.column, t.prob)] = low if up == 0 else low * (1 - up) + high * up
    return solved
