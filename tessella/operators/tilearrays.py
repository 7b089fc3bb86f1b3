"""Tiles as arrays: the same samples and sums as the row form, for tiles too wide to explode.

A frame is sampled once per covered tile with numpy inside a map over Arrow batches; only the tile's sums travel.
They are added in two steps over sorted partitions, one tile in memory at a time, so a tile that very many frames
cover is first summed in SPREAD parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.healpix import JPLL, JRLL
from .polygons import CUT, WCS, compress, cut_tiles

SPREAD = 8


def cell_centres(pix: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Right ascension and declination, in radians, of nested cells."""
    n = 1 << order
    face, inside = pix >> 2 * order, pix & (n * n - 1)
    x, y = compress(inside), compress(inside >> 1)
    jr = np.array(JRLL)[face] * n - x - y - 1
    nr = np.where(jr < n, jr, np.where(jr > 3 * n, 4 * n - jr, n))
    polar = (jr < n) | (jr > 3 * n)
    cap = nr.astype(float) ** 2 / (3.0 * n * n)
    z = np.where(jr < n, 1 - cap, np.where(jr > 3 * n, cap - 1, (2 * n - jr) * 2.0 / (3.0 * n)))
    shift = np.where(polar, 0, (jr - n) & 1)
    jp = (np.array(JPLL)[face] * nr + x - y + 1 + shift) // 2
    jp = np.where(jp > 4 * n, jp - 4 * n, np.where(jp < 1, jp + 4 * n, jp))
    return (jp - (shift + 1) * 0.5) * (np.pi / 2 / nr), np.arcsin(z)


def tile_grid(width: int) -> np.ndarray:
    """Place in the row-major tile of each cell in nested order."""
    k = np.arange(width * width)
    return (width - 1 - compress(k)) * width + compress(k >> 1)


def sample(npix: int, frame: dict, order: int, width: int, policy: str = "replace", overlay: str = "weighted", low: float = -np.inf, high: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Weighted values and weights, row-major, of one tile in one frame; zeros where the frame has nothing.

    `pixels` of the frame are those of its part x0, y0, w, h, if it has one.

    Only the overlays `weighted` and `fading` weigh pixels near the high edges down.
    """
    ra, dec = cell_centres(npix * width * width + np.arange(width * width), order + width.bit_length() - 1)
    w, h, d0 = frame["width"], frame["height"], np.radians(frame["crval2"])
    a = ra - np.radians(frame["crval1"])
    facing = np.sin(dec) * np.sin(d0) + np.cos(dec) * np.cos(d0) * np.cos(a)
    det = frame["cd1_1"] * frame["cd2_2"] - frame["cd1_2"] * frame["cd2_1"]
    with np.errstate(divide="ignore", invalid="ignore"):
        xi = np.degrees(np.cos(dec) * np.sin(a) / facing)
        eta = np.degrees((np.sin(dec) * np.cos(d0) - np.cos(dec) * np.sin(d0) * np.cos(a)) / facing)
        u = (frame["cd2_2"] * xi - frame["cd1_2"] * eta) / det + frame["crpix1"] - 1
        v = (frame["cd1_1"] * eta - frame["cd2_1"] * xi) / det + frame["crpix2"] - 1
    hit = np.flatnonzero((facing > 1e-10) & (u >= -0.5) & (u < w - 0.5) & (v >= -0.5) & (v < h - 0.5))
    wsum, wtot = np.zeros(width * width), np.zeros(width * width)
    if not len(hit):
        return wsum, wtot
    u, v = u[hit], v[hit]
    left, bottom = frame.get("x0", 0), frame.get("y0", 0)
    image = np.asarray(frame["pixels"], dtype=float).reshape(frame.get("h", h), frame.get("w", w))
    cx, cy = np.clip(u, 0, w - 1.001), np.clip(v, 0, h - 1.001)
    x0, y0 = np.floor(cx).astype(int), np.floor(cy).astype(int)
    fx, fy = cx - x0, cy - y0
    near = np.array([image[np.minimum(y0 + j, h - 1) - bottom, np.minimum(x0 + i, w - 1) - left] for j in (0, 1) for i in (0, 1)])
    if policy == "replace":
        first = near[0]
        for other in near[1:]:
            first = np.where(np.isnan(first), other, first)
        near = np.where(np.isnan(near), first, near)
    elif policy not in ("strict", "propagate"):
        raise ValueError(f"unknown blank policy {policy}")
    value = near[0] * (1 - fx) * (1 - fy) + near[1] * fx * (1 - fy) + near[2] * (1 - fx) * fy + near[3] * fx * fy
    weight = np.where((u >= w - 1.5) & (u < w - 1), 0.5, 1.0) * np.where((v >= h - 1.5) & (v < h - 1), 0.5, 1.0) if overlay in ("weighted", "fading") else np.ones(len(value))
    good = ~np.isnan(value) & (value >= low) & (value <= high)
    at = tile_grid(width)[hit[good]]
    wsum[at], wtot[at] = value[good] * weight[good], weight[good]
    return wsum, wtot


def sample_frames(frames: DataFrame, order: int, width: int, policy: str = "replace", overlay: str = "weighted", low: float = -np.inf, high: float = np.inf) -> DataFrame:
    """npix, image_id, wsum and wtot (row-major arrays) of every frame and tile that have pixels in common."""
    return sample_cuts(cut_tiles(frames, order), order, width, policy, overlay, low, high)


def sample_cuts(cuts: DataFrame, order: int, width: int, policy: str = "replace", overlay: str = "weighted", low: float = -np.inf, high: float = np.inf) -> DataFrame:
    """The same from the parts that `cut_tiles` gives."""

    def run(batches):
        for batch in batches:
            pixels = batch.column("pixels")
            rows = batch.drop_columns(["pixels"]).to_pylist()
            for k, row in enumerate(rows):
                wsum, wtot = sample(row["npix"], row | {"pixels": pixels[k].values.to_numpy(zero_copy_only=False)}, order, width, policy, overlay, low, high)
                if wtot.any():
                    yield pa.RecordBatch.from_arrays([pa.array([row["npix"]], pa.int64()), batch.column("image_id").slice(k, 1), pa.array([wsum]), pa.array([wtot])], ["npix", "image_id", "wsum", "wtot"])

    kind = cuts.schema["image_id"].dataType.simpleString()
    return cuts.select("npix", "image_id", *WCS, *CUT, "pixels").mapInArrow(run, f"npix long, image_id {kind}, wsum array<double>, wtot array<double>")


def _adding(first: bool):
    """Sums of sorted rows, or each pixel's first value, one tile in memory at a time."""

    def add(batches):
        npix, wsum, wtot = None, None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([npix], pa.int64()), pa.array([wsum]), pa.array([wtot])], ["npix", "wsum", "wtot"])

        for batch in batches:
            for n, a, b in zip(batch.column("npix").to_pylist(), batch.column("wsum"), batch.column("wtot"), strict=True):
                a, b = a.values.to_numpy(zero_copy_only=False), b.values.to_numpy(zero_copy_only=False)
                if n == npix:
                    new = (wtot == 0) if first else 1.0
                    wsum, wtot = wsum + a * new, wtot + b * new
                    continue
                if npix is not None:
                    yield row()
                npix, wsum, wtot = n, a, b
        if npix is not None:
            yield row()

    return add


def summed(parts: DataFrame) -> DataFrame:
    """npix, wsum and wtot: the sums over rows of a tile, in two steps so that a tile of very many rows is first summed in SPREAD parts."""
    schema, add = "npix long, wsum array<double>, wtot array<double>", _adding(False)
    spread = parts.withColumn("_s", F.pmod(F.xxhash64("npix", F.monotonically_increasing_id()), F.lit(SPREAD))).repartition("npix", "_s")
    partial = spread.sortWithinPartitions("npix").select("npix", "wsum", "wtot").mapInArrow(add, schema)
    return partial.repartition("npix").sortWithinPartitions("npix").mapInArrow(add, schema)


def coadd(sampled: DataFrame, overlay: str = "weighted") -> DataFrame:
    """npix and pixels: all frames of each tile put together, NaN where none has a value.

    add: the sum; first: the frame with the smallest image_id that has a value; the others: the mean by weight.
    """
    schema = "npix long, wsum array<double>, wtot array<double>"
    add = _adding(overlay == "first")
    if overlay == "first":  # an order decides, so a tile's frames pass by in one sorted run
        whole = sampled.repartition("npix").sortWithinPartitions("npix", "image_id").select("npix", "wsum", "wtot").mapInArrow(add, schema)
    else:
        spread = sampled.withColumn("_s", F.pmod(F.xxhash64("image_id"), F.lit(SPREAD))).repartition("npix", "_s")
        parts = spread.sortWithinPartitions("npix").select("npix", "wsum", "wtot").mapInArrow(add, schema)
        whole = parts.repartition("npix").sortWithinPartitions("npix").mapInArrow(add, schema)
    value = lambda s, t: F.when(t > 0, s if overlay == "add" else s / t).otherwise(float("nan"))
    return whole.select("npix", F.zip_with("wsum", "wtot", value).alias("pixels"))
