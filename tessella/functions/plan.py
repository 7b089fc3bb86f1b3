"""Helpers for the shape of plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fenced(df: DataFrame, cols: dict[str, Column], drop: tuple[str, ...] = ()) -> DataFrame:
    """`df` with columns that later filters use as they are.

    The optimiser moves a filter below a projection by copying the column's expression into it, and so on down
    a chain of projections, which multiplies long expressions. It doesn't move one below a generator, so the
    columns go through one that gives a single row.
    """
    kept = [c for c in df.columns if c not in cols and c not in drop]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(F.struct(*[v.alias(k) for k, v in cols.items()]))))
