"""Pixels: unnesting, sampling, weighting, co-adding, and the tile pyramid.

Images are rows with a dense row-major array, or, exploded, rows (key, x, y, value). NaN becomes null at
the door, because Spark's aggregates take NaN for a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import healpix as hp
from ..functions.plan import fenced
from . import orderstats


def unnest(images: DataFrame, pixels: str, width: int, keep: tuple[str, ...]) -> DataFrame:
    """One row (keep, x, y, value) per pixel; NaN values become null."""
    rows = images.select(*keep, F.posexplode(pixels).alias("_i", "_v"))
    value = F.col("_v").cast("double")
    return rows.select(*keep, (F.col("_i") % width).alias("x"), F.floor(F.col("_i") / width).cast("int").alias("y"), F.when(~F.isnan(value), value).alias("value"))


def scaled(pixels: str, scale: float, zero: float, blank: float | None = None) -> Column:
    """value * scale + zero for each pixel; blank and NaN pixels become null."""

    def one(v: Column) -> Column:
        v = v.cast("double")
        good = ~F.isnan(v) if blank is None else ~F.isnan(v) & (v != blank)
        return F.when(good, v * scale + zero)

    return F.transform(pixels, one)


def pixel(pixels: Column, x: Column, y: Column, width: Column | int, height: Column | int) -> Column:
    """The pixel at (x, y); null outside."""
    inside = (x >= 0) & (y >= 0) & (x < width) & (y < height)
    v = F.try_element_at(pixels, F.when(inside, (y * width + x + 1).cast("int")))
    return F.when(~F.isnan(v), v.cast("double"))


def with_bilinear(df: DataFrame, pixels: str, x: str, y: str, width: Column, height: Column, out: str = "value", policy: str = "replace", part: tuple[str, str, str, str] | None = None) -> DataFrame:
    """`df` with the image's value between pixels, at columns x and y.

    `part` names the columns x0, y0, w and h of the part of the image that `pixels` holds; without it that is all of it.

    Positions from -0.5 to size - 0.5 count. Of the four neighbours, blank ones take the value of the first that
    is not (`replace`), make the result null (`strict`), or count only if all are blank (`propagate`).
    """
    if policy not in ("replace", "strict", "propagate"):
        raise ValueError(f"unknown blank policy {policy}")
    px, py, fx, fy, first = (f"_bl_{k}" for k in ("px", "py", "fx", "fy", "first"))
    near = [f"_bl_{j}{i}" for j in (0, 1) for i in (0, 1)]
    u, v = F.col(x), F.col(y)
    inside = (u >= -0.5) & (u < width - 0.5) & (v >= -0.5) & (v < height - 0.5)
    left, bottom, across, up = map(F.col, part) if part else (F.lit(0), F.lit(0), width, height)
    cx, cy = F.least(F.greatest(u, F.lit(0.0)), width - 1.001), F.least(F.greatest(v, F.lit(0.0)), height - 1.001)
    steps = [
        {fx: cx, fy: cy},
        {px: F.floor(fx), py: F.floor(fy)},
        {n: pixel(F.col(pixels), F.col(px) + k % 2 - left, F.col(py) + k // 2 - bottom, across, up) for k, n in enumerate(near)} | {fx: F.col(fx) - F.col(px), fy: F.col(fy) - F.col(py)},
        {first: F.coalesce(*near)},
    ]
    if policy == "replace":
        steps.append({n: F.coalesce(n, first) for n in near})
    a, b, c, d = map(F.col, near)
    value = a * (1 - F.col(fx)) * (1 - F.col(fy)) + b * F.col(fx) * (1 - F.col(fy)) + c * (1 - F.col(fx)) * F.col(fy) + d * F.col(fx) * F.col(fy)
    for step in steps:
        df = df.withColumns(step)
    return fenced(df, {out: F.when(inside, value)}, drop=(px, py, fx, fy, first, *near))


def edge_weight(x: Column, y: Column, width: Column | int, height: Column | int) -> Column:
    """Half for each axis on which the position lies less than 1.5 and at least 1 pixel from the high edge."""
    half = lambda p, n: F.when((p >= n - 1.5) & (p < n - 1), 0.5).otherwise(1.0)
    return half(x, width) * half(y, height)


OVERLAYS = ("mean", "weighted", "first", "add", "fading")


def coadd(samples: DataFrame, by: tuple[str, ...], overlay: str = "mean", value: str = "value", weight: str = "weight", rank: str = "rank") -> DataFrame:
    """One value per pixel from its samples; null samples do not count, pixels without any are null.

    mean: unweighted; weighted and fading: sum of value times weight by the sum of weights; add: the sum;
    first: the sample with the smallest rank. Partial aggregates run before the shuffle.
    """
    good = F.col(value).isNotNull()
    w = F.when(good, F.col(weight)) if overlay in ("weighted", "fading") else None
    combined = {
        "mean": lambda: F.avg(value),
        "weighted": lambda: F.try_divide(F.sum(F.col(value) * w), F.sum(w)),
        "fading": lambda: F.try_divide(F.sum(F.col(value) * w), F.sum(w)),
        "add": lambda: F.sum(value),
        "first": lambda: F.min(F.when(good, F.struct(F.col(rank), F.col(value).alias("v"))))["v"],
    }
    if overlay not in combined:
        raise ValueError(f"unknown overlay {overlay}")
    return samples.groupBy(*by).agg(combined[overlay]().alias("value"), F.count(value).alias("n_samples"))


def downsample(tiles: DataFrame, width: int, layout: str = "hpx", allow_partial: bool = False) -> DataFrame:
    """Tiles one order up: (npix, x, y, value) with the mean of 2 x 2 pixels, nulls ignored.

    A parent needs all four children unless `allow_partial`. In the layout `hpx` a child stands in its quadrant of
    the nested order; in `row` child c stands at (c & 1, c >> 1).
    """
    child, half = F.col("npix").bitwiseAND(3), width // 2
    right, low = (F.shiftright(child, 1), 1 - child.bitwiseAND(1)) if layout == "hpx" else (child.bitwiseAND(1), F.shiftright(child, 1))
    moved = tiles.select(F.shiftright("npix", 2).alias("parent"), child.alias("child"), (right * half + F.floor(F.col("x") / 2)).cast("int").alias("x"), (low * half + F.floor(F.col("y") / 2)).cast("int").alias("y"), "value")
    means = moved.groupBy("parent", "child", "x", "y").agg(F.avg("value").alias("value"))  # a child's 2 x 2 pixels make one
    if not allow_partial:
        # One parent's pixels are at most width squared rows, so the window's groups are bounded.
        children = F.size(F.collect_set("child").over(Window.partitionBy("parent")))
        means = means.withColumn("_n", children).where("_n = 4")
    return means.select(F.col("parent").alias("npix"), "x", "y", "value")


def allsky(tiles: DataFrame, width: int, thumb: int, n_tiles: int) -> DataFrame:
    """The preview: every tile thinned to `thumb` pixels a side, rows flipped, in rows of floor(sqrt(n)) tiles."""
    gap, across = width // thumb, int(n_tiles**0.5)
    kept = tiles.where((F.col("x") % gap == 0) & (F.col("y") % gap == 0))
    column, row = F.col("npix") % across, F.floor(F.col("npix") / across)
    return kept.select((column * thumb + F.col("x") / gap).cast("int").alias("px"), (row * thumb + (thumb - 1) - F.floor(F.col("y") / gap)).cast("int").alias("py"), "value")


def local_maxima(pixels: DataFrame, by: tuple[str, ...], radius: int = 3) -> DataFrame:
    """Pixels that are the largest of their (2 radius + 1)-square, with `peak` true: a maximum over rows, then over columns."""
    across = Window.partitionBy(*by, "y").orderBy("x").rangeBetween(-radius, radius)
    down = Window.partitionBy(*by, "x").orderBy("y").rangeBetween(-radius, radius)
    return pixels.withColumn("_row", F.max("value").over(across)).withColumn("_max", F.max("_row").over(down)).withColumn("peak", F.col("value") == F.col("_max")).drop("_row", "_max")


def calibrated(raw: DataFrame, bias: DataFrame, flat: DataFrame, key: str = "image_id") -> DataFrame:
    """(raw - bias) / flat by pixel, where the flat is normed to a median of 1 and values below 0.1 count as 1."""
    middle = flat.agg(F.median("value").alias("_m"))
    normed = flat.crossJoin(F.broadcast(middle)).select("x", "y", (F.col("value") / F.col("_m")).alias("_f"))  # one row
    normed = normed.withColumn("_f", F.when(F.col("_f") < 0.1, 1.0).otherwise(F.col("_f")))
    frame = bias.select("x", "y", F.col("value").alias("_b")).join(normed, ["x", "y"])
    return raw.join(frame, ["x", "y"]).select(key, "x", "y", ((F.col("value") - F.col("_b")) / F.col("_f")).alias("value"))


def valid_range(values: DataFrame, value: str, known: tuple[float, float] | None = None) -> DataFrame:
    """One row: n, smallest, largest, and the smallest values with 1 % and 99 % of all up to them; nulls and NaN don't count.

    `known` is a range that headers give (DATAMIN, DATAMAX); it stands for the smallest and largest if it is in order and above 0.
    No task sees more than its own values: see `orderstats`.
    """
    good = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    n, low, high = good.agg(F.count("*"), F.min(value), F.max(value)).first()
    if known is not None and 0 < known[0] < known[1]:
        low, high = known
    p01, p99 = orderstats.quantiles(good, value, [0.01, 0.99]) if n else (None, None)
    row = (n, *[None if v is None else float(v) for v in (low, high, p01, p99)])
    return values.sparkSession.createDataFrame([row], "n long, low double, high double, p01 double, p99 double")


def hpx_tile_wcs(tiles: DataFrame, order: int, width: int) -> DataFrame:
    """npix with crpix1, crpix2 and the CD matrix of each tile in the HPX plane."""
    face, x, y = hp.face_xy("npix", order)
    n = hp.nside(order)
    facet_x = F.element_at(F.array(*map(F.lit, (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7))), (face + 1).cast("int"))
    facet_y = F.element_at(F.array(*map(F.lit, (1, 1, 1, 1, 0, 0, 0, 0, -1, -1, -1, -1))), (face + 1).cast("int"))
    # Centre of the tile in degrees of the plane: facets are squares on their corner, 45 degrees from centre to corner.
    cx = (facet_x + (x - y) / F.lit(float(n))) * 45.0
    cy = (facet_y + (x + y + 1 - n) / F.lit(float(n))) * 45.0
    step = 45.0 / (n * width)
    return tiles.select("npix", (F.lit((width + 1) / 2.0) - (-cx - cy) / (2 * step)).alias("crpix1"), (F.lit((width + 1) / 2.0) - (cx - cy) / (2 * step)).alias("crpix2"), F.lit(-step).alias("cd1_1"), F.lit(-step).alias("cd1_2"), F.lit(step).alias("cd2_1"), F.lit(-step).alias("cd2_2"))
