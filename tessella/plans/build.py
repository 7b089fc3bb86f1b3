"""Whole runs: a full build of the pyramid, an append, and which stages a run has."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import healpix as hp
from ..functions import wcs
from ..functions.plan import fenced
from ..operators import cutouts, images, tilearrays
from ..operators.incremental import append_allowed, apply_batch
from ..operators.polygons import CUT, WCS, cut_tiles


#: Tiles up to this many pixels across are sampled by expressions, one row per pixel.
NARROW = 16


@dataclass(frozen=True)
class Options:
    """What a run does."""

    order: int = 3
    tile_width: int = 8
    overlay: str = "weighted"
    low: float = float("-inf")
    high: float = float("inf")
    tree: bool = False
    append: bool = False
    tiles: bool = True
    blank_policy: str = "replace"


def runs_tree(tree: bool, tiles: bool, append: bool, order: int) -> bool:
    """Lower orders are built when asked for, with tiles, not in an append, and if there are any."""
    return tree and tiles and not append and order > 0


def first_output_order(tree: bool, order: int) -> int:
    """The lowest order that a run writes."""
    return 0 if tree else order


def defers_preview(tree: bool, order: int) -> bool:
    """The preview waits for the tree when the highest order lies above its own, 3."""
    return tree and order > 3


def chunk_size(tasks: int, workers: int) -> int:
    """Tasks handed out at once: a quarter of a worker's share, between 1 and 64."""
    return max(1, min(64, -(-tasks // max(1, workers * 4))))


def sample_tiles(frames: DataFrame, options: Options) -> DataFrame:
    """npix, x, y, source, value, weight: every tile pixel's sample in every frame that covers its tile.

    Each frame's task cuts out what its tiles need; frames aren't joined, and the samples are expressions over the
    parts, so no pixel table is joined either.
    """
    return samples_of(cut_tiles(frames, options.order), options)


def samples_of(cuts: DataFrame, options: Options) -> DataFrame:
    """The samples of the parts that `cut_tiles` gives, or that `cut_files` reads."""
    w = options.tile_width
    cells = cuts.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(w * w - 1)))).withColumn("_cell", F.col("npix") * (w * w) + F.col("_k"))
    cells = hp.with_centre(cells, options.order + w.bit_length() - 1, "_cell")
    x, y = hp.hpx2xy("_k", w)
    u, v = wcs.sky2pix("ra", "dec", wcs.wcs_of())
    placed = cells.select("image_id", "npix", x.cast("int").alias("x"), y.cast("int").alias("y"), *WCS, *CUT, "pixels", "ra", "dec")
    placed = fenced(placed, {"_u": u, "_v": v})
    placed = placed.where(wcs.inside("_u", "_v", "width", "height", -0.5))
    sampled = images.with_bilinear(placed, "pixels", "_u", "_v", F.col("width"), F.col("height"), policy=options.blank_policy, part=CUT)
    weight = images.edge_weight(F.col("_u"), F.col("_v"), F.col("width"), F.col("height"))
    sampled = sampled.select("npix", "x", "y", F.col("image_id").alias("source"), "value", weight.alias("weight"))
    return sampled.where(F.col("value").isNotNull() & F.col("value").between(options.low, options.high))


def wide_tiles(frames: DataFrame, options: Options) -> DataFrame:
    """The same as `narrow_tiles`, with tiles as arrays until all frames are put together: for wide tiles."""
    return _wide(cut_tiles(frames, options.order), options)


def _wide(cuts: DataFrame, options: Options) -> DataFrame:
    w = options.tile_width
    sampled = tilearrays.sample_cuts(cuts, options.order, w, options.blank_policy, options.overlay, options.low, options.high)
    pixels = tilearrays.coadd(sampled, options.overlay).select("npix", F.posexplode("pixels").alias("k", "value")).where(~F.isnan("value"))
    return pixels.select("npix", (F.col("k") % w).alias("x"), F.floor(F.col("k") / w).cast("int").alias("y"), "value")


def narrow_tiles(frames: DataFrame, options: Options) -> DataFrame:
    """npix, x, y and value: the samples of every tile pixel put together by the overlay; `first` goes by image_id."""
    return _narrow(cut_tiles(frames, options.order), options)


def _narrow(cuts: DataFrame, options: Options) -> DataFrame:
    return images.coadd(samples_of(cuts, options), ("npix", "x", "y"), options.overlay, rank="source").select("npix", "x", "y", "value")


def build(frames: DataFrame, options: Options) -> dict[int, DataFrame]:
    """Tiles (npix, x, y, value) by order: the highest, and with `tree` all below it.

    Tiles of more than NARROW pixels across are put together as arrays, narrower ones as rows of samples.
    """
    return build_cuts(cut_tiles(frames, options.order), options)


def build_files(spark: SparkSession, path: str, options: Options, tiles: DataFrame | None = None, **files) -> dict[int, DataFrame]:
    """The same from FITS files below `path`, with their paths as image_id; `files` are options of the format `fits`.

    With `tiles` (npix of the highest order) only those are built, and only what they need is fetched: the way to rebuild the
    tiles that an append made dirty.
    """
    return build_cuts(cutouts.cut_files(spark, path, options.order, tiles, **files), options)


def build_cuts(cuts: DataFrame, options: Options) -> dict[int, DataFrame]:
    """The same from the parts of frames that tiles need."""
    if options.overlay not in images.OVERLAYS:
        raise ValueError(f"unknown overlay {options.overlay}")
    tiles = (_narrow if options.tile_width <= NARROW else _wide)(cuts, options)
    out = {options.order: tiles}
    if runs_tree(options.tree, options.tiles, options.append, options.order):
        for order in range(options.order - 1, -1, -1):
            out[order] = images.downsample(out[order + 1], options.tile_width)
    return out


def epoch_builds(observations: DataFrame, frames: DataFrame, by: tuple[str, ...], options: Options) -> DataFrame:
    """by, npix, x, y and value: one build for each group of observations (image_id and `by`), all in one job.

    The observations say which frames a group has; a frame may be in several groups. Tiles stay rows of samples, so
    for wide tiles call `build` for each group's frames instead.
    """
    chosen = frames.drop(*by).join(observations.select("image_id", *by).distinct(), "image_id")
    # The group goes into the key of a frame, since one frame may stand in several groups.
    keyed = chosen.withColumn("image_id", F.struct("image_id", *by))
    samples = sample_tiles(keyed.drop(*by), options).select("*", *[F.col(f"source.{c}").alias(c) for c in by])
    return images.coadd(samples, (*by, "npix", "x", "y"), options.overlay, rank="source").select(*by, "npix", "x", "y", "value")


def tile_counts(tiles: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, n_tiles and n_pixels: what each group's build wrote."""
    return tiles.groupBy(*by).agg(F.countDistinct("npix").alias("n_tiles"), F.count("value").alias("n_pixels"))


def append(state: DataFrame, frames: DataFrame, options: Options) -> DataFrame:
    """The state after new frames; equal to a build of all frames' state."""
    append_allowed(has_index=state is not None, weighted=options.overlay in ("mean", "weighted"))
    return apply_batch(state, sample_tiles(frames, options))
