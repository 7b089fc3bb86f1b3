"""Keeping the index and the co-added state up to date as new frames arrive.

State is additive: every tile pixel keeps its weighted sum and total weight per source, so a delivered source
replaces its former contribution, and delivering it twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("npix", "filepath")


def merge_index(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """npix, filepath, cellmem and `changed`: the union by key, where the incoming cellmem wins.

    A row is changed if its key is new or its cellmem differs. Of rows that repeat a key within one side, the one
    with the largest cellmem counts.
    """
    old = existing.groupBy(*KEYS).agg(F.max("cellmem").alias("_old"))
    new = incoming.groupBy(*KEYS).agg(F.max("cellmem").alias("_new"))
    both = old.join(new, list(KEYS), "full")
    changed = F.col("_new").isNotNull() & (F.col("_old").isNull() | (F.col("_old") != F.col("_new")))
    return both.select(*KEYS, F.coalesce("_new", "_old").alias("cellmem"), changed.alias("changed"))


def dirty_tiles(merged: DataFrame) -> DataFrame:
    """The distinct tiles that have a changed source."""
    return merged.where("changed").select("npix").distinct()


def accumulate(samples: DataFrame) -> DataFrame:
    """npix, x, y, source, wsum and wtot: the state of samples (npix, x, y, source, value, weight)."""
    good = samples.where(F.col("value").isNotNull())
    return good.groupBy("npix", "x", "y", "source").agg(F.sum(F.col("value") * F.col("weight")).alias("wsum"), F.sum("weight").alias("wtot"))


def apply_batch(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The state after a batch of samples: sources of the batch replace what they had contributed."""
    fresh = accumulate(batch)
    delivered = batch.select("source").distinct()
    return state.join(delivered, "source", "left_anti").select(fresh.columns).unionByName(fresh)


def tiles_of(state: DataFrame) -> DataFrame:
    """npix, x, y and the weighted mean of the state."""
    return state.groupBy("npix", "x", "y").agg(F.try_divide(F.sum("wsum"), F.sum("wtot")).alias("value"))


def rebuild_dirty(tiles: DataFrame, state: DataFrame, dirty: DataFrame) -> DataFrame:
    """`tiles` with the dirty ones computed anew from the state and the others as they are."""
    fresh = tiles_of(state.join(dirty, "npix", "left_semi"))
    return tiles.join(dirty, "npix", "left_anti").select(fresh.columns).unionByName(fresh)


def append_allowed(has_index: bool, weighted: bool) -> None:
    """Appending needs an index and an additive overlay."""
    if not has_index:
        raise ValueError("append needs an existing index")
    if not weighted:
        raise ValueError("append needs an overlay with additive state: mean or weighted")
