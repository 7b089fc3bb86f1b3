"""Additive tile state: the sums of each tile as arrays, and a ledger of the sources that are in them.

A part is one folder of sums and one of ledger rows, both under the part's number. The sums are written first; a part counts
once its ledger is there, and writing a part again replaces it, so a batch that runs twice leaves the same state. A source
that the ledger holds in the same version is never added again. Sums can't be taken back: tiles of a source that comes in a
new version are computed afresh from all frames, and a tile's rows from before that no longer count. `compact` puts all
parts into one, so the state's size follows the tiles, not the sources.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tilearrays
from .polygons import cut_tiles, footprint_cells

TILES = "npix long, wsum array<double>, wtot array<double>, afresh boolean, part long"
LEDGER = "source string, version string, part long, replaces array<bigint>"


def _read(spark: SparkSession, path: str, kind: str, schema: str, without: int | None = None) -> DataFrame:
    """All finished parts of a kind but `without`, the one that is about to be written; none if nothing was written yet."""
    root = f"{path.rstrip('/')}/{kind}"
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.parquet").option("recursiveFileLookup", "true").load(root)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    parts = [r[0] for r in files.select(F.element_at(F.split("path", "/"), -2)).distinct().collect() if r[0] != str(without)]  # one per batch
    return spark.read.schema(schema).parquet(*[f"{root}/{p}" for p in parts]) if parts else spark.createDataFrame([], schema)


def _write(df: DataFrame, path: str, kind: str, part: int) -> None:
    df.withColumn("part", F.lit(part).cast("long")).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{kind}/{part}")


def ledger(spark: SparkSession, path: str, without: int | None = None) -> DataFrame:
    """source, version and part of what the state holds: the latest version of each source. Part `without` is left out."""
    rows = _read(spark, path, "ledger", LEDGER, without)
    gone = rows.select(F.explode("replaces").alias("part")).distinct()
    live = rows.join(gone, "part", "left_anti").where("source is not null")
    return live.groupBy("source").agg(F.max(F.struct("part", "version")).alias("m")).select("source", F.col("m.version").alias("version"), F.col("m.part").alias("part"))


def sums(spark: SparkSession, path: str, width: int, without: int | None = None) -> DataFrame:
    """npix, wsum and wtot of every tile; fails if a tile's width is another. Part `without` is left out."""
    rows = _read(spark, path, "ledger", LEDGER, without)
    gone = rows.select(F.explode("replaces").alias("part")).distinct()
    live = rows.select("part").distinct().join(gone, "part", "left_anti")
    tiles = _read(spark, path, "tiles", TILES, without).join(live, "part", "left_semi")
    first = tiles.where("afresh").groupBy("npix").agg(F.max("part").alias("_first"))
    counted = tiles.join(first, "npix", "left").where("_first is null or part >= _first")
    fits_in = (F.size("wsum") == width * width) & (F.size("wtot") == width * width)
    checked = counted.withColumn("wsum", F.when(fits_in, F.col("wsum")).otherwise(F.raise_error(F.concat(F.lit("the state has tiles of another width: "), F.size("wsum").cast("string"), F.lit(" pixels")))))
    return tilearrays.summed(checked.select("npix", "wsum", "wtot"))


def tiles_of(state: DataFrame, overlay: str = "weighted") -> DataFrame:
    """npix and pixels: the values that the sums stand for, NaN without any."""
    value = lambda s, t: F.when(t > 0, s if overlay == "add" else s / t).otherwise(float("nan"))
    return state.select("npix", F.zip_with("wsum", "wtot", value).alias("pixels"))


def _sums_of(frames: DataFrame, order: int, width: int, overlay: str, low: float, high: float, tiles: DataFrame | None = None) -> DataFrame:
    cuts = cut_tiles(frames, order)
    cuts = cuts if tiles is None else cuts.join(tiles, "npix", "left_semi")
    return tilearrays.summed(tilearrays.sample_cuts(cuts, order, width, "replace", overlay, low, high).select("npix", "wsum", "wtot"))


def merge(path: str, frames: DataFrame, order: int, width: int, part: int, overlay: str = "weighted", low: float = -np.inf, high: float = np.inf) -> DataFrame:
    """Add the sources of `frames` (image_id, version, WCS, pixels) that are new to the state, as part number `part`.

    Returns npix of the tiles that need `recompute`: those of sources that the ledger holds in another version, which
    are not added. A source that comes twice in `frames` counts once. Overlays: weighted, mean, fading and add, whose sums add up.
    """
    if overlay == "first":
        raise ValueError("the overlay first has no additive state")
    spark = frames.sparkSession
    known = ledger(spark, path, part).select("source", F.col("version").alias("_known"))
    named = frames.dropDuplicates(["image_id"]).withColumn("source", F.col("image_id").cast("string")).join(known, "source", "left")
    new = named.where("_known is null").drop("_known", "source")
    _write(_sums_of(new.drop("version"), order, width, overlay, low, high).withColumn("afresh", F.lit(False)), path, "tiles", part)
    none = F.array().cast("array<bigint>").alias("replaces")
    _write(new.select(F.col("image_id").cast("string").alias("source"), F.col("version").cast("string").alias("version"), none), path, "ledger", part)
    changed = named.where("_known is not null and not (_known <=> cast(version as string))").drop("_known")
    return footprint_cells(changed, order, ()).distinct()


def recompute(path: str, tiles: DataFrame, frames: DataFrame, order: int, width: int, part: int, overlay: str = "weighted", low: float = -np.inf, high: float = np.inf) -> None:
    """Compute `tiles` (npix) afresh from all frames, as part `part`: what the state held of them counts no longer.

    `frames` are all frames in the versions that hold from now on; those that the ledger doesn't know are left to `merge`.
    `tiles` are those that changed sources leave or enter: elsewhere the state stays as it is.
    """
    wanted = tiles.select("npix").distinct()
    known = ledger(frames.sparkSession, path, part).select("source")
    frames = frames.withColumn("source", F.col("image_id").cast("string")).join(known, "source", "left_semi").drop("source")
    fresh = _sums_of(frames.drop("version"), order, width, overlay, low, high, wanted)
    empty = F.array_repeat(F.lit(0.0), width * width)  # a tile that no frame covers any more
    whole = wanted.join(fresh, "npix", "left").select("npix", F.coalesce("wsum", empty).alias("wsum"), F.coalesce("wtot", empty).alias("wtot"), F.lit(True).alias("afresh"))
    _write(whole, path, "tiles", part)
    none = F.array().cast("array<bigint>").alias("replaces")
    _write(frames.select(F.col("image_id").cast("string").alias("source"), F.col("version").cast("string").alias("version"), none).distinct(), path, "ledger", part)


def lacking(state: DataFrame, dirty: DataFrame, index: DataFrame) -> DataFrame:
    """npix of dirty tiles that have earlier sources in the index but no state: additive merging would lose those."""
    return dirty.select("npix").distinct().join(index.select("npix").distinct(), "npix", "left_semi").join(state.select("npix"), "npix", "left_anti")


def compact(spark: SparkSession, path: str, width: int, part: int) -> None:
    """Put all parts into one, number `part`; the others stay on disk but count no longer."""
    old = [r["part"] for r in _read(spark, path, "ledger", LEDGER, part).select("part").distinct().collect()]  # one per batch
    _write(sums(spark, path, width, part).withColumn("afresh", F.lit(True)), path, "tiles", part)
    every = ledger(spark, path, part).select("source", "version").withColumn("replaces", F.array().cast("array<bigint>"))
    mark = spark.createDataFrame([(None, None, old)], "source string, version string, replaces array<bigint>")
    _write(every.unionByName(mark), path, "ledger", part)


def sink(path: str, frames_of: Callable[[DataFrame], DataFrame], order: int, width: int, overlay: str = "weighted", stale: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps additive state; `frames_of` loads a batch's frames, `stale` gets tiles to recompute.

    The batch's number is the part's, so a batch that runs again after a failure replaces what it wrote.
    """

    def run(batch: DataFrame, number: int) -> None:
        found = merge(path, frames_of(batch), order, width, number, overlay)
        if stale is not None:
            stale(found, number)

    return run
