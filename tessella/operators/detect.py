"""Sources on smoothed images, and the shift between where a catalogue predicts stars and where an image has them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from .measure import nearest_pixel

DIGITS = 9  # smoothed values are equal if they agree so far


def smoothed(image: np.ndarray, sigma: float) -> np.ndarray:
    """The image convolved with a round Gaussian cut at four sigma, its edges extended; blanks take the median."""
    image = np.where(np.isnan(image), np.nanmedian(image) if not np.isnan(image).all() else 0.0, image)
    reach = max(1, math.ceil(4 * sigma))
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma * sigma))
    kernel /= kernel.sum()
    for axis in (1, 0):
        padded = np.pad(image, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        n = image.shape[axis]
        image = sum(w * (padded[:, k : k + n] if axis else padded[k : k + n]) for k, w in enumerate(kernel))
    return np.round(image, DIGITS)


def peaks(image: np.ndarray, sigma: float, radius: int, sigmas: float, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y and value of the brightest local maxima of the smoothed image above its median and `sigmas` deviations."""
    s = smoothed(image, sigma)
    high = s
    for axis in (0, 1):
        padded = np.pad(high, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)], constant_values=-np.inf)
        high = np.lib.stride_tricks.sliding_window_view(padded, 2 * radius + 1, axis=axis).max(-1)
    y, x = np.nonzero((s == high) & (s > np.median(s) + sigmas * s.std()))
    first = np.lexsort((x, y, -s[y, x]))[:top]
    return x[first], y[first], s[y[first], x[first]]


def detect(frames: DataFrame, by: tuple[str, ...], sigma: float = 1.2, radius: int = 3, sigmas: float = 3.0, top: int = 250) -> DataFrame:
    """by, x, y and value of the `top` brightest sources of every frame (by, width, height, pixels).

    A source is the largest pixel of its square of 2 radius + 1 on the smoothed image, above the median and `sigmas` standard
    deviations; of equal ones the first by row counts first. Blank pixels take the frame's median. One frame is in memory at a time.
    """
    schema = StructType([frames.schema[c] for c in by]).add("x", IntegerType()).add("y", IntegerType()).add("value", DoubleType())

    def run(batches):
        for batch in batches:
            widths, heights, pixels = batch.column("width").to_pylist(), batch.column("height").to_pylist(), batch.column("pixels")
            for k in range(batch.num_rows):
                if not pixels[k].is_valid or not widths[k] or not heights[k]:
                    continue
                x, y, v = peaks(pixels[k].values.to_numpy(zero_copy_only=False).astype(float).reshape(heights[k], widths[k]), sigma, radius, sigmas, top)
                keys = batch.select(list(by)).take(pa.array(np.full(len(x), k))).columns
                yield pa.RecordBatch.from_arrays([*keys, pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(v)], schema.names)

    return frames.select(*by, "width", "height", "pixels").mapInArrow(run, schema)


def catalogue_shift(frames: DataFrame, predicted: DataFrame, by: tuple[str, ...], reach: float = 200.0, bin_size: float = 4.0, near: float = 8.0, least: int = 3, border: float = 20.0, **detection) -> DataFrame:
    """by, dx, dy, votes, n_matched and refined: how far each frame's sources are from the predicted places (by, id, x, y).

    Offsets of less than `reach` vote in bins around multiples of `bin_size`; of bins with equal votes the smallest counts. Predicted
    places moved by the winner are matched with the nearest source within `near`; `least` matches or more give their median offset,
    fewer leave the winner. Only places more than `border` inside the frame count. A frame without votes has a shift of zero.
    """
    found = detect(frames, by, **detection)
    size = frames.select(*by, "width", "height")
    inner = predicted.join(size, list(by)).where((F.col("x") > border) & (F.col("y") > border) & (F.col("x") < F.col("width") - border) & (F.col("y") < F.col("height") - border)).select(*by, "id", "x", "y")
    # Places meet the sources of their own and the eight cells around, a cell being as wide as the reach.
    cells = F.explode(F.expr("flatten(transform(array(-1, 0, 1), i -> transform(array(-1, 0, 1), j -> struct(i, j))))"))
    p = inner.select(*by, F.col("x").alias("px"), F.col("y").alias("py")).withColumn("_c", cells)
    p = p.select(*by, "px", "py", (F.floor(F.col("px") / reach) + F.col("_c.i")).alias("_gx"), (F.floor(F.col("py") / reach) + F.col("_c.j")).alias("_gy"))
    q = found.select(*by, "x", "y", F.floor(F.col("x") / reach).alias("_gx"), F.floor(F.col("y") / reach).alias("_gy"))
    offsets = q.join(p, [*by, "_gx", "_gy"]).select(*by, (F.col("x") - F.col("px")).alias("ox"), (F.col("y") - F.col("py")).alias("oy")).where((F.abs("ox") < reach) & (F.abs("oy") < reach))
    votes = offsets.groupBy(*by, F.floor(F.col("ox") / bin_size + 0.5).alias("bx"), F.floor(F.col("oy") / bin_size + 0.5).alias("by_")).agg(F.count("*").alias("votes"))
    winner = votes.groupBy(*by).agg(F.min(F.struct((-F.col("votes")).alias("v"), "bx", "by_")).alias("w"))
    winner = winner.select(*by, (F.col("w.bx") * bin_size).alias("cx"), (F.col("w.by_") * bin_size).alias("cy"), (-F.col("w.v")).alias("votes"))
    moved = inner.join(winner, list(by)).select(*by, "id", (F.col("x") + F.col("cx")).alias("x"), (F.col("y") + F.col("cy")).alias("y"))
    sources = found.select(*by, (F.col("y").cast("long") * (1 << 32) + F.col("x")).alias("id"), "x", "y")
    matched = nearest_pixel(moved, sources, by, near).where(F.col("distance") < near)
    back = matched.join(inner.withColumnRenamed("id", "left_id"), [*by, "left_id"])
    apart = back.select(*by, (F.col("right_id") % (1 << 32) - F.col("x")).alias("ox"), (F.floor(F.col("right_id") / (1 << 32)) - F.col("y")).alias("oy"))
    fine = apart.groupBy(*by).agg(F.median("ox").alias("fx"), F.median("oy").alias("fy"), F.count("*").alias("n"))
    out = frames.select(*by).join(winner, list(by), "left").join(fine, list(by), "left")
    good = F.coalesce(F.col("n") >= least, F.lit(False))
    pick = lambda a, b: F.coalesce(F.when(good, F.col(a)).otherwise(F.col(b)), F.lit(0.0))
    return out.select(*by, pick("fx", "cx").alias("dx"), pick("fy", "cy").alias("dy"), F.coalesce("votes", F.lit(0)).alias("votes"), F.coalesce("n", F.lit(0)).alias("n_matched"), good.alias("refined"))
