"""Exact order statistics of a whole column without sorting or gathering it.

Each rank has an open interval that holds its value. A round takes a quantile sketch of the values inside, whose partial
sketches merge, and then counts the values below, at and between the two ends that the sketch gives. The counts decide,
so the result is exact however good the sketch is; what is left shrinks by a factor of about ACCURACY / 4 a round.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000
#: So many values are brought to the driver and sorted there.
FEW = 1_000


@dataclass
class _Search:
    """A rank (from 0) whose value lies strictly between `low` and `high`, with `below` values up to `low` and `left` between."""

    rank: int
    low: float
    high: float
    below: int
    left: int
    found: float | None = None

    def inside(self, v):
        return (v > self.low) & (v < self.high)


def at_ranks(values: DataFrame, column: str, ranks: list[int]) -> list[float]:
    """The values at `ranks`, counted from 0 in ascending order; nulls and NaN don't count. A rank outside gives NaN."""
    v = F.col("v")
    rows = values.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, low, high = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    ends = rows.agg(F.count_if(v == low), F.count_if(v == high)).first() if n else (0, 0)
    searches = []
    for rank in ranks:
        s = _Search(rank, low, high, ends[0], n - ends[0] - ends[1])
        s.found = math.nan if not 0 <= rank < n else low if rank < ends[0] else high if rank >= n - ends[1] else None
        searches.append(s)
    while open_ := [s for s in searches if s.found is None]:
        for s in [s for s in open_ if s.left <= FEW]:
            held = rows.where(s.inside(v)).groupBy("v").count().collect()  # FEW values at most
            at = s.below
            for r in sorted(held):
                at += r["count"]
                if s.rank < at:
                    s.found = r["v"]
                    break
        open_ = [s for s in open_ if s.found is None]
        if not open_:
            continue
        shares = [((s.rank - s.below) / s.left - 2 / ACCURACY, (s.rank - s.below + 1) / s.left + 2 / ACCURACY) for s in open_]
        sketch = rows.agg(*[F.percentile_approx(F.when(s.inside(v), v), [max(a, 0.0), min(b, 1.0)], ACCURACY).alias(f"q{k}") for k, (s, (a, b)) in enumerate(zip(open_, shares, strict=True))]).first()
        counts = []
        for k, s in enumerate(open_):
            a, b = sketch[f"q{k}"]
            counts += [F.count_if(s.inside(v) & (v < a)), F.count_if(s.inside(v) & (v == a)), F.count_if(s.inside(v) & (v > a) & (v < b)), F.count_if(s.inside(v) & (v == b))]
        numbers = rows.agg(*[c.alias(f"c{k}") for k, c in enumerate(counts)]).first()
        for k, s in enumerate(open_):
            (a, b), (less, at_a, between, at_b) = sketch[f"q{k}"], numbers[4 * k : 4 * k + 4]
            at_b = 0 if a == b else at_b
            place = s.rank - s.below
            if place < less:
                s.high, s.left = a, less
            elif place < less + at_a:
                s.found = a
            elif place < less + at_a + between:
                s.low, s.high, s.below, s.left = a, b, s.below + less + at_a, between
            elif place < less + at_a + between + at_b:
                s.found = b
            else:
                above = less + at_a + between + at_b
                s.low, s.below, s.left = b, s.below + above, s.left - above
    return [s.found for s in searches]


def quantiles(values: DataFrame, column: str, shares: list[float], interpolate: bool = False) -> list[float]:
    """The values at shares of all values: the smallest with at least that share up to it, or, interpolated, between neighbours."""
    n = values.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).count()
    if not interpolate:
        return at_ranks(values, column, [max(math.ceil(p * n) - 1, 0) for p in shares])
    places = [p * (n - 1) for p in shares]
    ranks = sorted({r for x in places for r in (math.floor(x), math.ceil(x))})
    at = dict(zip(ranks, at_ranks(values, column, ranks), strict=True))
    return [at[math.floor(x)] + (at[math.ceil(x)] - at[math.floor(x)]) * (x - math.floor(x)) for x in places]
