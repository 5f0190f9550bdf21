"""Exact quantiles of columns without carrying all their values to one task."""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From this many values on, the ranks are found by selection. Both ways give the same numbers.
DIRECT = 1_000_000
#: A sketch's ranks are off by one part in this many; how far off decides the number of rounds, not the result.
ACCURACY = 50_000
#: As many values between two cuts, at most, are listed in one aggregate.
LISTED = 10_000


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each column; null and NaN don't count, and a column of none gives nulls.

    Few values: one exact aggregate. Many: distributed selection (``_selected``), whose largest aggregate sees a fixed
    number of values, however many rows there are. ``df`` is read several times: pass a table, not a long plan."""
    x = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in columns}
    counts = df.agg(*(F.count(v).alias(f"n{i}") for i, v in enumerate(x.values()))).first()
    n = dict(zip(columns, counts, strict=True))
    few = [c for c in columns if n[c] <= DIRECT]
    out: dict[str, list[float | None]] = {}
    if few:
        row = df.agg(*(F.percentile(x[c], F.array(*(F.lit(float(q)) for q in shares))).alias(f"q{i}") for i, c in enumerate(few))).first()
        out = {c: list(row[i]) if row[i] else [None] * len(shares) for i, c in enumerate(few)}
    many = {c: [q * (n[c] - 1) for q in shares] for c in columns if c not in out}
    if many:
        found = _selected(df, {c: x[c] for c in many}, n, {(c, r) for c, at in many.items() for p in at for r in (math.floor(p), math.ceil(p))})
        for c, at in many.items():
            ends = [(found[c, math.floor(p)], found[c, math.ceil(p)], p - math.floor(p)) for p in at]
            out[c] = [a if a == b else a + (b - a) * part for a, b, part in ends]
    return out


@dataclass(frozen=True)
class _Gap:
    """The values of a column strictly between two cuts: ``size`` of them, after ``before`` others; None is no bound."""

    column: str
    low: float | None
    high: float | None
    before: int
    size: int

    def inside(self, x: Column) -> Column:
        held = x.isNotNull()
        held = held if self.low is None else held & (x > F.lit(self.low))
        return F.when(held if self.high is None else held & (x < F.lit(self.high)), x)


def _selected(df: DataFrame, x: dict[str, Column], n: dict[str, int], wanted: set[tuple[str, int]]) -> dict[tuple[str, int], float]:
    """Values at ranks (from 0) of columns.

    A round sketches the values of each gap that still holds a wanted rank, takes as cuts what the sketch has a little
    before and after each rank, and counts the values below and at each cut. A rank then lies at a cut, and is
    found, or in a narrower gap. Gaps shrink by a fixed factor a round even with ties, as values that equal a cut lie
    in none, and counts are exact, so a poor sketch costs rounds only. Small gaps are listed."""
    found: dict[tuple[str, int], float] = {}
    open_: dict[_Gap, list[int]] = {}
    for c, r in wanted:
        open_.setdefault(_Gap(c, None, None, 0, n[c]), []).append(r)
    while open_:
        small = {g: rs for g, rs in open_.items() if g.size <= LISTED}
        if small:
            found |= _listed(df, x, small)
        wide = {g: rs for g, rs in open_.items() if g not in small}
        open_ = {}
        if wide:
            for gap, rs, cuts in _cuts(df, x, wide):
                for r in rs:
                    i = bisect.bisect_right([below for _, below, _ in cuts], r) - 1  # the last cut that doesn't lie after r
                    if i >= 0 and r < cuts[i][2]:
                        found[gap.column, r] = cuts[i][0]
                        continue
                    low, before = (cuts[i][0], cuts[i][2]) if i >= 0 else (gap.low, gap.before)
                    high, end = (cuts[i + 1][0], cuts[i + 1][1]) if i + 1 < len(cuts) else (gap.high, gap.before + gap.size)
                    open_.setdefault(_Gap(gap.column, low, high, before, end - before), []).append(r)
    return found


def _cuts(df: DataFrame, x: dict[str, Column], gaps: dict[_Gap, list[int]]) -> list[tuple[_Gap, list[int], list[tuple[float, int, int]]]]:
    """Cuts of each gap in order: value, how many values of the column are below it, how many are not above it."""
    items = list(gaps.items())
    ends = [sorted({min(1.0, max(0.0, (r - g.before) / g.size + s)) for r in rs for s in (-2 / ACCURACY, 2 / ACCURACY)}) for g, rs in items]
    sketches = df.agg(*(F.percentile_approx(g.inside(x[g.column]), e, ACCURACY).alias(f"s{i}") for i, ((g, _), e) in enumerate(zip(items, ends, strict=True)))).first()
    cuts = [(i, v) for i, s in enumerate(sketches) for v in sorted(set(s))]
    counts = df.agg(*(F.count_if(f(x[items[i][0].column], F.lit(v))).alias(f"c{k}{j}") for k, (i, v) in enumerate(cuts) for j, f in enumerate((Column.__lt__, Column.__le__)))).first()
    out = [(g, rs, []) for g, rs in items]
    for k, (i, v) in enumerate(cuts):
        out[i][2].append((v, counts[2 * k], counts[2 * k + 1]))
    return out


def _listed(df: DataFrame, x: dict[str, Column], gaps: dict[_Gap, list[int]]) -> dict[tuple[str, int], float]:
    """The wanted ranks of gaps of at most LISTED values, each listed in order."""
    items = list(gaps.items())
    ordered = lambda g: F.sort_array(F.collect_list(g.inside(x[g.column])))
    pick = lambda g, rs: F.array(*(F.get(ordered(g), F.lit(r - g.before)) for r in rs))
    row = df.agg(*(pick(g, rs).alias(f"v{i}") for i, (g, rs) in enumerate(items))).first()
    return {(g.column, r): v for (g, rs), values in zip(items, row, strict=True) for r, v in zip(rs, values, strict=True)}
