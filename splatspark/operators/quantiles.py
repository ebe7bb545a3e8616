"""Exact quantiles of whole columns in bounded memory.

A sketch of bounded size narrows each wanted rank to a window of values, one aggregate counts what lies below and inside, and only
windows of at most ``GATHER`` values are gathered. Larger windows get a sketch of their own, thousands of times narrower each time, so no task
holds more than sketches and small windows, however many rows or ties there are. Counts confirm every window: a sketch that missed is widened.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relative error of a sketch is one over this.
ACCURACY = 10_000
#: Most values of a window that are gathered and sorted.
GATHER = 50_000


@dataclass
class _Rank:
    """The value of rank ``k`` (from 0) of a column: it lies strictly between ``low`` and ``high`` (None: no bound), where ``inside`` values lie, ``below`` of all are before them."""

    name: str
    k: int
    inside: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    slack: float = 2.0 / ACCURACY
    found: float | None = None

    def window(self, c: Column) -> Column:
        keep = c.isNotNull()
        keep = keep & (c > F.lit(self.low)) if self.low is not None else keep
        return F.when(keep & (c < F.lit(self.high)) if self.high is not None else keep, c)


def exact(rows: DataFrame, columns: dict[str, Column], wanted: tuple[float, ...]) -> dict[str, list[float | None]]:
    """For each column the interpolated quantiles, as ``percentile`` gives them. Nulls don't count; no value at all gives None.
    Columns and quantiles are few (parameters); what reaches the driver is one row a pass."""
    names = list(columns)
    base = rows.select(*[columns[n].cast("double").alias(f"v{i}") for i, n in enumerate(names)])
    at = {n: F.col(f"v{i}") for i, n in enumerate(names)}
    sizes = base.agg(*[F.count(at[n]) for n in names]).first()
    count = dict(zip(names, sizes))
    place = {(n, p): p * (count[n] - 1) for n in names for p in wanted if count[n]}
    ranks = {(n, k): _Rank(n, k, count[n]) for (n, _), h in place.items() for k in {math.floor(h), math.ceil(h)}}
    while left := [x for x in ranks.values() if x.found is None]:
        if small := _shared([x for x in left if x.inside <= GATHER]):
            got = base.agg(*[_picked(at, same) for same in small]).first()
            for same, values in zip(small, got):
                for x, value in zip(same, values):
                    x.found = value
        if large := _shared([x for x in left if x.inside > GATHER]):
            _narrow(base, at, large)
    value = lambda n, k: ranks[n, k].found
    return {n: [_between(value(n, math.floor(h)), value(n, math.ceil(h)), h) if (h := place.get((n, p))) is not None else None for p in wanted] for n in names}


def _shared(ranks: list[_Rank]) -> list[list[_Rank]]:
    """Ranks by their window: each window is gathered, or has its sketch, once."""
    found: dict[tuple, list[_Rank]] = {}
    for x in ranks:
        found.setdefault((x.name, x.low, x.high), []).append(x)
    return list(found.values())


def _picked(at: dict[str, Column], same: list[_Rank]) -> Column:
    values = F.sort_array(F.collect_list(same[0].window(at[same[0].name])))
    return F.transform(F.array(*[F.lit(x.k - x.below + 1) for x in same]), lambda i: F.element_at(values, i))


def _ends(x: _Rank) -> tuple[float, float]:
    """Shares of a window round the rank, on a grid finer than a sketch, so that neighbouring ranks mostly have the same."""
    grid, share = 4 * ACCURACY, (x.k - x.below + 0.5) / x.inside
    return max(0.0, math.floor((share - x.slack) * grid) / grid), min(1.0, math.ceil((share + x.slack) * grid) / grid)


def _narrow(base: DataFrame, at: dict[str, Column], windows: list[list[_Rank]]) -> None:
    shares = [[e for x in same for e in _ends(x)] for same in windows]
    sketches = base.agg(*[F.percentile_approx(same[0].window(at[same[0].name]), e, ACCURACY) for same, e in zip(windows, shares)]).first()
    ends = [(x, found[2 * i], found[2 * i + 1]) for same, found in zip(windows, sketches) for i, x in enumerate(same)]
    edges = list({(x.name, e) for x, a, b in ends for e in (a, b)})
    counts = base.agg(*[F.count_if(t) for n, e in edges for t in (at[n] < F.lit(e), at[n] <= F.lit(e))]).first()
    before = {k: counts[2 * i] for i, k in enumerate(edges)}
    upto = {k: counts[2 * i + 1] for i, k in enumerate(edges)}
    for x, a, b in ends:
        low, high = (x.name, a), (x.name, b)
        if before[low] <= x.k < upto[low]:
            x.found = a
        elif upto[low] <= x.k < before[high]:
            x.low, x.high, x.below, x.inside, x.slack = a, b, upto[low], before[high] - upto[low], 2.0 / ACCURACY
        elif before[high] <= x.k < upto[high]:
            x.found = b
        else:
            x.slack *= 8


def _between(low: float, high: float, place: float) -> float:
    share = place - math.floor(place)
    return low if low == high or not share else (1 - share) * low + share * high
