"""Measuring sources: backgrounds, apertures, zero points, combination, differences."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.photometry import SIGMA_PER_MAD
from ..functions.plan import fenced


#: Values of a group whose median is taken by one task.
LARGE = 200_000
#: Of the sketch that tells where a large group's median is; counts decide, so the result doesn't depend on it.
ACCURACY = 10_000


def clip_sigma(rows: DataFrame, by: tuple[str, ...], value: str, sigmas: float = 3.0, rounds: int = 3) -> DataFrame:
    """by, background, rms and n after `rounds` passes that drop values more than `sigmas` deviations off the median.

    The passes are grouped aggregates joined back; their number is fixed, so the plan is. Groups of more than LARGE values, whose
    median no task can hold, are clipped by `_clip_large`.
    """
    kept = rows.where(F.col(value).isNotNull()).select(*by, value)
    large = kept.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > LARGE).select(*by).na.drop().collect()  # one row for LARGE values at most
    if large:
        own = F.broadcast(rows.sparkSession.createDataFrame(large, StructType([kept.schema[c] for c in by])))
        return _clip(kept.join(own, list(by), "left_anti"), by, value, sigmas, rounds).unionByName(_clip_large(kept.join(own, list(by)), by, value, sigmas, rounds))
    return _clip(kept, by, value, sigmas, rounds)


def _clip(kept: DataFrame, by: tuple[str, ...], value: str, sigmas: float, rounds: int) -> DataFrame:
    """`clip_sigma` of groups whose values a task can hold."""
    for _ in range(rounds):
        stats = kept.groupBy(*by).agg(F.median(value).alias("_m"), F.stddev_pop(value).alias("_s"))
        kept = kept.join(stats, list(by)).where(F.abs(F.col(value) - F.col("_m")) <= sigmas * F.col("_s")).select(*by, value)
    return kept.groupBy(*by).agg(F.median(value).alias("background"), F.stddev_pop(value).alias("rms"), F.count("*").alias("n"))


def _clip_large(kept: DataFrame, by: tuple[str, ...], value: str, sigmas: float, rounds: int) -> DataFrame:
    """`clip_sigma` of large groups; a row for each of them goes through the driver in every pass."""
    spark, keys, v = kept.sparkSession, [kept.schema[c] for c in by], F.col(value)
    for turn in range(rounds + 1):
        stats = large_medians(kept, by, value).collect()
        if turn < rounds:
            own = spark.createDataFrame([(*r[: len(by)], r["median"], r["sd"]) for r in stats], StructType([*keys, StructField("_m", DoubleType()), StructField("_s", DoubleType())]))
            kept = kept.join(F.broadcast(own), list(by)).where(F.abs(v - F.col("_m")) <= sigmas * F.col("_s")).select(*by, value)
    return spark.createDataFrame([(*r[: len(by)], r["median"], r["sd"], r["n"]) for r in stats], StructType([*keys, StructField("background", DoubleType()), StructField("rms", DoubleType()), StructField("n", LongType())]))


def large_medians(rows: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    """by, median, sd (of the population) and n of groups that are few but large; values aren't null.

    A sketch gives two values around the median. Counts below and between them tell which of the three parts holds the two middle
    ranks; the values of that part alone are counted one by one and summed up in order. Two rows a group go through the driver.
    """
    spark, keys, v = rows.sparkSession, [rows.schema[c] for c in by], F.col(value).cast("double")
    near = F.percentile_approx(v, [0.5 - 2 / ACCURACY, 0.5 + 2 / ACCURACY], ACCURACY)
    sketch = rows.groupBy(*by).agg(near.alias("_q"), F.count("*").alias("n"), F.stddev_pop(v).alias("sd")).collect()
    fields = lambda *names: StructType([*keys, *[StructField(c, LongType() if c in ("n", "_r1", "_r2", "_before") else DoubleType()) for c in names]])
    ends = spark.createDataFrame([(*r[: len(by)], *r["_q"]) for r in sketch], fields("_a", "_b"))
    counts = {tuple(r[: len(by)]): r for r in rows.join(F.broadcast(ends), list(by)).groupBy(*by).agg(F.count_if(v < F.col("_a")).alias("below"), F.count_if(v <= F.col("_b")).alias("upto")).collect()}
    wanted = []
    for r in sketch:
        c, ranks = counts[tuple(r[: len(by)])], ((r["n"] - 1) // 2, r["n"] // 2)
        parts = [0 if k < c["below"] else 1 if k < c["upto"] else 2 for k in ranks]
        low = (-math.inf, r["_q"][0], math.nextafter(r["_q"][1], math.inf))[parts[0]]
        high = (math.nextafter(r["_q"][0], -math.inf), r["_q"][1], math.inf)[parts[1]]
        wanted.append((*r[: len(by)], low, high, (0, c["below"], c["upto"])[parts[0]], *ranks, r["sd"], r["n"]))
    own = spark.createDataFrame(wanted, fields("_low", "_high", "_before", "_r1", "_r2", "sd", "n"))
    held = rows.join(F.broadcast(own), list(by)).where(v.between(F.col("_low"), F.col("_high"))).groupBy(*own.columns, v.alias("_v")).agg(F.count("*").alias("_k"))
    upto = F.col("_before") + F.sum("_k").over(Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    at = lambda rank: F.min(F.when(F.col("_upto") > F.col(rank), F.col("_v")))
    return held.withColumn("_upto", upto).groupBy(*by, "sd", "n").agg(((at("_r1") + at("_r2")) / 2).alias("median"))


def mesh(rows: DataFrame, cell: int, value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """The clipped background of every mesh cell, then its median over the 3 x 3 cells around it."""
    cells = clip_sigma(rows.withColumn("mx", F.floor(F.col("x") / cell)).withColumn("my", F.floor(F.col("y") / cell)), (*by, "mx", "my"), value)
    spread = cells.withColumn("_d", F.explode(F.expr("flatten(transform(array(-1, 0, 1), i -> transform(array(-1, 0, 1), j -> struct(i, j))))")))
    shifted = spread.select(*by, (F.col("mx") + F.col("_d.i")).alias("mx"), (F.col("my") + F.col("_d.j")).alias("my"), "background", "rms")
    smooth = shifted.groupBy(*by, "mx", "my").agg(F.median("background").alias("smooth_background"), F.median("rms").alias("smooth_rms"))
    return cells.join(smooth, [*by, "mx", "my"])


def background_surface(pixels: DataFrame, by: tuple[str, ...], width: int, height: int, cell: int = 64, least: float = 0.5) -> DataFrame:
    """by, x, y, value, background, rms, and `flat` (whether the image's background is one number) of every pixel.

    A mesh cell with values in at least the share `least` of its pixels has a clipped median and scatter; another takes the
    median of its good neighbours, or of all good cells of the image. The mesh is smoothed by the median over 3 x 3 cells and
    interpolated between the centres of cells; beyond the outermost centres it goes on level. An image without a good cell takes
    the clipped median and scatter of all its values; one without values has null ones.
    """
    across, up = -(-width // cell), -(-height // cell)
    placed = pixels.withColumns({"mx": F.floor(F.col("x") / cell).cast("int"), "my": F.floor(F.col("y") / cell).cast("int")})
    side = lambda m, size: F.least(F.lit(cell), F.lit(size) - F.col(m) * cell)
    full = placed.groupBy(*by, "mx", "my").agg(F.count("value").alias("_n")).where(F.col("_n") >= least * side("mx", width) * side("my", height))
    good = clip_sigma(placed, (*by, "mx", "my"), "value").join(full, [*by, "mx", "my"], "left_semi").select(*by, "mx", "my", "background", "rms")
    # All cells of images that have a good one; the mesh is small beside the pixels.
    places = F.explode(F.expr(f"flatten(transform(sequence(0, {across - 1}), i -> transform(sequence(0, {up - 1}), j -> struct(i AS mx, j AS my))))"))
    overall = good.groupBy(*by).agg(F.median("background").alias("_all"), F.median("rms").alias("_all_rms"))
    mesh_cells = overall.withColumn("_c", places).select(*by, "_all", "_all_rms", "_c.mx", "_c.my")
    offsets = F.explode(F.expr("flatten(transform(array(-1, 0, 1), i -> transform(array(-1, 0, 1), j -> struct(i, j))))"))

    def around(cells: DataFrame) -> DataFrame:
        """Each cell's numbers under its neighbours' places and its own."""
        moved = cells.withColumn("_d", offsets)
        return moved.select(*by, (F.col("mx") + F.col("_d.i")).alias("mx"), (F.col("my") + F.col("_d.j")).alias("my"), "background", "rms")

    near = around(good).groupBy(*by, "mx", "my").agg(F.median("background").alias("_near"), F.median("rms").alias("_near_rms"))
    filled = mesh_cells.join(good, [*by, "mx", "my"], "left").join(near, [*by, "mx", "my"], "left")
    filled = filled.select(*by, "mx", "my", F.coalesce("background", "_near", "_all").alias("background"), F.coalesce("rms", "_near_rms", "_all_rms").alias("rms"))
    smooth = around(filled).groupBy(*by, "mx", "my").agg(F.median("background").alias("background"), F.median("rms").alias("rms"))
    smooth = smooth.where(F.col("mx").between(0, across - 1) & F.col("my").between(0, up - 1))
    # Each cell with the nine values that its pixels are interpolated between; at the rim the nearest cell stands in.
    asked = mesh_cells.select(*by, "mx", "my").withColumn("_d", offsets).select(
        *by, "mx", "my", ((F.col("_d.i") + 1) * 3 + F.col("_d.j") + 1).alias("_k"),
        F.least(F.greatest(F.col("mx") + F.col("_d.i"), F.lit(0)), F.lit(across - 1)).alias("_x"), F.least(F.greatest(F.col("my") + F.col("_d.j"), F.lit(0)), F.lit(up - 1)).alias("_y"),
    )
    named = smooth.withColumnsRenamed({"mx": "_x", "my": "_y"})
    nine = asked.join(named, [*by, "_x", "_y"]).groupBy(*by, "mx", "my").agg(F.sort_array(F.collect_list(F.struct("_k", "background", "rms"))).alias("_nine"))
    whole = clip_sigma(pixels, by, "value").select(*by, F.col("background").alias("_whole"), F.col("rms").alias("_whole_rms"))
    rows = placed.join(nine, [*by, "mx", "my"], "left").join(whole, list(by), "left")
    t, v = ((F.col(c) + 0.5) / cell - 0.5 - F.col(m) for c, m in (("x", "mx"), ("y", "my")))
    rows = rows.withColumns({"_i": F.when(t < 0, -1).otherwise(0), "_j": F.when(v < 0, -1).otherwise(0)}).withColumns({"_fx": t - F.col("_i"), "_fy": v - F.col("_j")})

    def between(name: str) -> Column:
        at = lambda i, j: F.element_at("_nine", ((F.col("_i") + i + 1) * 3 + F.col("_j") + j + 2).cast("int"))[name]
        fx, fy = F.col("_fx"), F.col("_fy")
        return at(0, 0) * (1 - fx) * (1 - fy) + at(1, 0) * fx * (1 - fy) + at(0, 1) * (1 - fx) * fy + at(1, 1) * fx * fy

    return rows.select(
        *by, "x", "y", "value", F.coalesce(between("background"), "_whole").alias("background"), F.coalesce(between("rms"), "_whole_rms").alias("rms"), F.col("_nine").isNull().alias("flat")
    )


def aperture(pixels: DataFrame, by: tuple[str, ...], x0, y0, radius: float, inner: float, outer: float, noise: str = "sky_scatter") -> DataFrame:
    """by, n_pixels, sky, flux, flux_err and snr of a round aperture with a sky annulus.

    The error is sqrt(|flux| + n var(sky)) (`sky_scatter`) or sqrt(|flux| + n |sky|) (`sky_level`).
    """
    r2 = (F.col("x") - x0) * (F.col("x") - x0) + (F.col("y") - y0) * (F.col("y") - y0)
    in_ap, in_sky = r2 <= radius * radius, (r2 >= inner * inner) & (r2 <= outer * outer)
    v = F.col("value")
    sums = pixels.groupBy(*by).agg(
        F.count(F.when(in_ap, v)).alias("n_pixels"), F.sum(F.when(in_ap, v)).alias("_sum"),
        F.median(F.when(in_sky, v)).alias("sky"), F.var_pop(F.when(in_sky, v)).alias("_var"),
    )
    flux = F.col("_sum") - F.col("sky") * F.col("n_pixels")
    per_pixel = {"sky_scatter": F.col("_var"), "sky_level": F.abs("sky")}[noise]
    err = F.sqrt(F.abs(flux) + F.col("n_pixels") * per_pixel)
    return sums.select(*by, "n_pixels", "sky", flux.alias("flux"), err.alias("flux_err"), F.try_divide(flux, err).alias("snr"))


#: Positions measured at a time.
SPOTS = 4096


def _spots(image: np.ndarray, x0: np.ndarray, y0: np.ndarray, radius: float, inner: float, outer: float) -> tuple[np.ndarray, ...]:
    """Per position: pixels and sum in the aperture; pixels, median and variance in the annulus. NaN pixels and those off the image don't count."""
    reach = int(outer) + 1
    border, g = reach + 1, np.arange(-reach, reach + 1)
    padded = np.pad(image, border, constant_values=np.nan)
    left, top = np.rint(x0).astype(np.int64), np.rint(y0).astype(np.int64)
    v = padded[(top + border)[:, None, None] + g[None, :, None], (left + border)[:, None, None] + g[None, None, :]].reshape(len(x0), -1)
    dx, dy = (left - x0)[:, None] + g, (top - y0)[:, None] + g
    r2 = ((dx * dx)[:, None, :] + (dy * dy)[:, :, None]).reshape(len(x0), -1)
    good = ~np.isnan(v)
    hole, ring = good & (r2 <= radius * radius), good & (r2 >= inner * inner) & (r2 <= outer * outer)
    n, m = hole.sum(1), ring.sum(1)
    ordered, at = np.sort(np.where(ring, v, np.inf), axis=1), np.arange(len(x0))
    count = np.maximum(m, 1)
    sky = (ordered[at, (count - 1) // 2] + ordered[at, count // 2]) / 2
    mean = np.where(ring, v, 0).sum(1) / count
    off = np.where(ring, v - mean[:, None], 0)
    return n, np.where(hole, v, 0).sum(1), m, sky, (off * off).sum(1) / count


def apertures_at(positions: DataFrame, frames: DataFrame, radius: float, inner: float, outer: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """image_id, star_id, `keep`, n_pixels, sky, flux, flux_err and snr at positions (image_id, star_id, x, y, keep) of frames; see `aperture`.

    Frames (image_id, width, height, pixels) and positions meet in sorted partitions, and pixels are looked up in the frame:
    none becomes a row. One frame and SPOTS positions are in memory at a time.
    """
    spots = positions.where("image_id is not null").select("image_id", F.lit(1).alias("_kind"), "star_id", "x", "y", *keep)
    images = frames.where("image_id is not null and pixels is not null").select("image_id", F.lit(0).alias("_kind"), "width", "height", F.col("pixels").cast("array<double>").alias("pixels"))
    both = spots.unionByName(images, allowMissingColumns=True).repartition("image_id").sortWithinPartitions("image_id", "_kind")
    kept = ("image_id", "star_id", *keep)
    schema = StructType([both.schema[c] for c in kept] + [StructField(c, t) for c, t in (("n_pixels", LongType()), ("sky", DoubleType()), ("_sum", DoubleType()), ("_var", DoubleType()))])

    def run(batches):
        held, image = None, None
        for batch in batches:
            ids, kinds = batch.column("image_id"), batch.column("_kind").to_numpy()
            x0, y0 = batch.column("x").to_numpy(zero_copy_only=False), batch.column("y").to_numpy(zero_copy_only=False)
            rows, found = [], []
            starts = np.flatnonzero(kinds == 0)
            for a, b in zip(np.r_[-1, starts], np.r_[starts, batch.num_rows], strict=True):
                if a >= 0:
                    held = ids[int(a)]
                    size = batch.column("height")[int(a)].as_py(), batch.column("width")[int(a)].as_py()
                    image = batch.column("pixels")[int(a)].values.to_numpy(zero_copy_only=False).astype(float).reshape(size)
                if image is None or b - a < 2:
                    continue
                own = a + 1 + np.flatnonzero(pc.equal(ids.slice(int(a) + 1, int(b - a - 1)), held).to_numpy(zero_copy_only=False))
                for k in range(0, len(own), SPOTS):
                    part = own[k : k + SPOTS]
                    rows.append(part)
                    found.append(_spots(image, x0[part], y0[part], radius, inner, outer))
            if rows:
                n, total, m, sky, var = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([
                    *batch.select(list(kept)).take(pa.array(np.concatenate(rows))).columns, pa.array(n, pa.int64()), pa.array(sky, mask=m == 0), pa.array(total, mask=n == 0), pa.array(var, mask=m == 0),
                ], schema.names)

    sums = both.select(*kept, "_kind", "x", "y", "width", "height", "pixels").mapInArrow(run, schema)
    flux = F.col("_sum") - F.col("sky") * F.col("n_pixels")
    err = F.sqrt(F.abs(flux) + F.col("n_pixels") * F.col("_var"))
    return sums.select(*kept, "n_pixels", "sky", flux.alias("flux"), err.alias("flux_err"), F.try_divide(flux, err).alias("snr"))


def with_zero_point(rows: DataFrame, by: tuple[str, ...], offset: str = "offset", least: int = 3, floor: float = 0.05) -> DataFrame:
    """`rows` with zp, zp_err and n_used of their group; those with a null offset get them too but don't count. See `zero_point`."""
    group = Window.partitionBy(*by)
    d = rows.withColumn("_m", F.median(offset).over(group)).withColumn("_d", F.abs(F.col(offset) - F.col("_m")))
    d = d.withColumn("_used", F.when(F.col("_d") < 3 * F.greatest(F.median("_d").over(group), F.lit(floor)), F.col(offset)))
    n = F.count("_used").over(group)
    d = d.withColumns({"n_used": n, "_zp": F.median("_used").over(group), "_s": F.stddev_pop("_used").over(group)})
    enough = F.col("n_used") >= least
    return d.withColumns({"zp": F.when(enough, F.col("_zp")), "zp_err": F.when(enough, F.col("_s") / F.sqrt("n_used"))}).drop("_m", "_d", "_used", "_zp", "_s")


def zero_point(matches: DataFrame, by: tuple[str, ...], offset: str = "offset", least: int = 3, floor: float = 0.05) -> DataFrame:
    """by, zp, zp_err, n_used: the median of reference less instrumental magnitudes after a clip.

    Offsets farther from the group's median than three times its median absolute deviation (at least `floor`) are
    dropped; groups with fewer than `least` stars left have null zp.
    """
    middle = Window.partitionBy(*by)
    d = matches.where(F.col(offset).isNotNull()).withColumn("_m", F.median(offset).over(middle)).withColumn("_d", F.abs(F.col(offset) - F.col("_m")))
    d = d.withColumn("_mad", F.median("_d").over(middle)).where(F.col("_d") < 3 * F.greatest("_mad", F.lit(floor)))
    out = d.groupBy(*by).agg(F.median(offset).alias("_zp"), F.stddev_pop(offset).alias("_s"), F.count("*").alias("n_used"))
    enough = F.col("n_used") >= least
    return out.select(*by, F.when(enough, F.col("_zp")).alias("zp"), F.when(enough, F.col("_s") / F.sqrt("n_used")).alias("zp_err"), "n_used")


def robust_scatter(rows: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    """by, median and 1.4826 times the median absolute deviation."""
    middle = rows.groupBy(*by).agg(F.median(value).alias("median"))
    return rows.join(middle, list(by)).groupBy(*by, "median").agg((SIGMA_PER_MAD * F.median(F.abs(F.col(value) - F.col("median")))).alias("scatter"), F.count(value).alias("n"))


def difference(epoch: DataFrame, reference: DataFrame, by: tuple[str, ...], threshold: float = 5.0) -> DataFrame:
    """Statistics of epoch less reference, pixel by pixel: see `difference_statistics`."""
    d = epoch.join(reference.withColumnRenamed("value", "_ref"), [*by, "x", "y"]).select(*by, "x", "y", (F.col("value") - F.col("_ref")).alias("d")).where("d is not null")
    return difference_statistics(d, by, threshold)


def difference_statistics(d: DataFrame, by: tuple[str, ...], threshold: float = 5.0) -> DataFrame:
    """Of differences (by, x, y, d): background, sigma, peak and where, signal, snr, recovered.

    sigma is 1.4826 times the median absolute deviation, the standard deviation where that is zero, at least 1e-6.
    Of several largest pixels the first in row order counts.
    """
    middle = d.groupBy(*by).agg(F.median("d").alias("background"))
    r = d.join(middle, list(by)).withColumn("d", F.col("d") - F.col("background"))
    stats = r.groupBy(*by, "background").agg(
        (SIGMA_PER_MAD * F.median(F.abs("d"))).alias("_mad"), F.stddev_pop("d").alias("_sd"), F.sum("d").alias("signal"), F.count("*").alias("n"),
        F.max(F.struct("d", (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))).alias("_p"),
    )
    sigma = F.greatest(F.when(F.col("_mad") > 0, F.col("_mad")).otherwise(F.col("_sd")), F.lit(1e-6))
    out = stats.select(*by, "background", sigma.alias("sigma"), F.col("_p.d").alias("peak"), (-F.col("_p.nx")).alias("peak_x"), (-F.col("_p.ny")).alias("peak_y"), "signal", "n")
    snr = F.col("signal") / (F.col("sigma") * F.sqrt("n"))
    return out.withColumn("peak_snr", F.col("peak") / F.col("sigma")).withColumn("snr", snr).withColumn("recovered", snr >= threshold)


def with_peak_snr(images: DataFrame, d: str, out: str = "peak_snr") -> DataFrame:
    """Rows with an array `d` of differences, none of them null, and the peak over sigma of `difference_statistics`; `d` is dropped."""
    middle = lambda c: (F.element_at(c, F.floor((F.size(c) + 1) / 2).cast("int")) + F.element_at(c, (F.floor(F.size(c) / 2) + 1).cast("int"))) / 2
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda a, v: a + f(v))
    rows = fenced(images.where(F.size(d) > 0), {"_s": F.sort_array(d)}, drop=(d,))
    rows = fenced(rows, {"_m": middle(F.col("_s")), "_mean": total(F.col("_s"), lambda v: v) / F.size("_s")})
    off = F.sort_array(F.transform("_s", lambda v: F.abs(v - F.col("_m"))))
    rows = fenced(rows, {"_off": off, "_sd": F.sqrt(total(F.col("_s"), lambda v: (v - F.col("_mean")) * (v - F.col("_mean"))) / F.size("_s")), "_peak": F.element_at("_s", -1) - F.col("_m")}, drop=("_s",))
    rows = fenced(rows, {"_mad": SIGMA_PER_MAD * middle(F.col("_off"))}, drop=("_off",))
    sigma = F.greatest(F.when(F.col("_mad") > 0, F.col("_mad")).otherwise(F.col("_sd")), F.lit(1e-6))
    return rows.withColumn(out, F.col("_peak") / sigma).drop("_m", "_mean", "_sd", "_peak", "_mad")


def difference_photometry(epoch: DataFrame, reference: DataFrame, by: tuple[str, ...], x0, y0, radius: float, inner: float, outer: float) -> DataFrame:
    """The aperture photometry of epoch less reference at a target's own position; see `aperture`.

    Pixels that only one side has do not count. The error comes from the scatter of the difference in the annulus.
    """
    d = epoch.join(reference.withColumnRenamed("value", "_ref"), [*by, "x", "y"]).select(*by, "x", "y", (F.col("value") - F.col("_ref")).alias("value"))
    return aperture(d, by, x0, y0, radius, inner, outer)


def background_like(pixels: DataFrame, by: tuple[str, ...], width: int, height: int, sigmas: float = 1.5, margin: int = 0) -> DataFrame:
    """Pixels less than `sigmas` robust deviations off their group's median and `margin` off the edges.

    The deviation is 1.4826 times the median absolute deviation; where that is zero nothing is background-like.
    """
    stats = robust_scatter(pixels.where("value is not null"), by, "value").select(*by, "median", "scatter")
    inner = F.col("x").between(margin, width - 1 - margin) & F.col("y").between(margin, height - 1 - margin)
    return pixels.where(inner).join(stats, list(by)).where(F.abs(F.col("value") - F.col("median")) < sigmas * F.col("scatter")).select(*by, "x", "y", "value")


#: Pairs whose offsets are counted at a time, bins that are counted in one array, and detected positions of a cell in one group.
OFFSETS, BINS, PIECE = 1 << 18, 1 << 22, 4096


def _counted(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, reach: float, bin_size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of the offsets of less than `reach` from any (px, py) to any (x, y), and how many fall into each."""
    first = math.floor(-reach / bin_size)
    side = math.floor(reach / bin_size) - first + 1
    total, few = np.zeros(side * side if side * side <= BINS else 0, np.int64), []
    order = np.argsort(px, kind="stable")
    px, py = px[order], py[order]
    at = np.argsort(x, kind="stable")
    x, y = x[at], y[at]
    step = max(1, min(len(x), 64))
    for k in range(0, len(x), step):
        a, b = x[k : k + step, None], y[k : k + step, None]
        # Places within reach of this run of positions along x, with room for rounding.
        low, high = np.searchsorted(px, a[0, 0] - reach * (1 + 1e-9)), np.searchsorted(px, a[-1, 0] + reach * (1 + 1e-9), side="right")
        near = low + np.flatnonzero((py[low:high] > b.min() - reach * (1 + 1e-9)) & (py[low:high] < b.max() + reach * (1 + 1e-9)))
        for j in range(0, len(near), OFFSETS // step):
            part = near[j : j + OFFSETS // step]
            ox, oy = a - px[part], b - py[part]
            ok = (np.abs(ox) < reach) & (np.abs(oy) < reach)
            bins = (np.floor(ox[ok] / bin_size) - first).astype(np.int64) * side + (np.floor(oy[ok] / bin_size) - first).astype(np.int64)
            if len(total):
                total += np.bincount(bins, minlength=len(total))
            else:
                few.append(np.unique(bins, return_counts=True))
    if len(total):
        found = np.flatnonzero(total)
        counts = total[found]
    else:
        found, at = np.unique(np.concatenate([f[0] for f in few] or [np.zeros(0, np.int64)]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([f[1] for f in few] or [np.zeros(0)]), len(found)).astype(np.int64)
    return found // side + first, found % side + first, counts


def _votes(q: DataFrame, p: DataFrame, by: tuple[str, ...], reach: float, bin_size: float) -> DataFrame:
    """by, bx, by_ and count of the offsets between positions q (by, x, y) and p (by, px, py).

    Positions of a cell of `reach` meet the places of its own and the eight cells around; cells of many positions are cut into pieces of
    about PIECE, which are tasks of their own.
    """
    keys = [*by, "_gx", "_gy"]
    q = q.withColumns({"_gx": F.floor(F.col("x") / reach), "_gy": F.floor(F.col("y") / reach)})
    pieces = q.groupBy(*keys).agg(F.ceil(F.count("*") / PIECE).alias("_pieces"))
    q = q.join(pieces, keys).withColumn("_piece", F.pmod(F.xxhash64("x", "y"), F.col("_pieces"))).select(*keys, "_piece", "x", "y")
    p = p.withColumn("_c", F.explode(F.expr("flatten(transform(array(-1, 0, 1), i -> transform(array(-1, 0, 1), j -> struct(i, j))))")))
    p = p.withColumns({"_gx": F.floor(F.col("px") / reach) + F.col("_c.i"), "_gy": F.floor(F.col("py") / reach) + F.col("_c.j")})
    p = p.join(pieces, keys).withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1))).select(*keys, "_piece", "px", "py")
    schema = StructType([q.schema[c] for c in by] + [StructField(c, LongType()) for c in ("bx", "by_", "count")])

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        x, y, px, py = (t.column(c).to_numpy() for t, c in ((one, "x"), (one, "y"), (other, "px"), (other, "py")))
        bx, by_, n = _counted(x, y, px, py, reach, bin_size)
        kept = one.select(list(by)).slice(0, 1).take(pa.array(np.zeros(len(n), np.int64))) if len(x) else one.select(list(by))
        return pa.table([*kept.columns, pa.array(bx, pa.int64()), pa.array(by_, pa.int64()), pa.array(n, pa.int64())], schema.names)

    p = p.withColumnsRenamed({c: f"_p{c}" for c in (*keys, "_piece")})
    counts = q.groupBy(*keys, "_piece").cogroup(p.groupBy(*[f"_p{c}" for c in (*keys, "_piece")])).applyInArrow(run, schema)
    return counts.groupBy(*by, "bx", "by_").agg(F.sum("count").alias("count"))


def shift_vote(detected: DataFrame, predicted: DataFrame, by: tuple[str, ...], reach: float = 200.0, bin_size: float = 4.0) -> DataFrame:
    """by, dx, dy, votes: the most common offset between detected and predicted positions, then the median around it.

    All pairs within `reach` vote, which is quadratic in a field's positions; they are counted without becoming rows.
    """
    q = detected.select(*by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).na.drop()
    p = predicted.select(*by, F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py")).na.drop()
    votes = _votes(q, p, by, reach, bin_size)
    best = votes.groupBy(*by).agg(F.max(F.struct("count", (-F.col("bx")).alias("nx"), (-F.col("by_")).alias("ny"))).alias("b")).select(*by, (-F.col("b.nx")).alias("bx"), (-F.col("b.ny")).alias("by_"), F.col("b.count").alias("votes"))
    # Places moved by the winner meet what lies around them, on cells twice as wide as the reach around the bin's middle.
    size = 2 * bin_size * (1 + 1e-9)
    moved = p.join(best, list(by)).withColumns({"_mx": F.floor((F.col("px") + (F.col("bx") + 0.5) * bin_size) / size - 0.5), "_my": F.floor((F.col("py") + (F.col("by_") + 0.5) * bin_size) / size - 0.5)})
    moved = moved.withColumn("_c", F.explode(F.expr("flatten(transform(array(0, 1), i -> transform(array(0, 1), j -> struct(i, j))))"))).withColumns({"_gx": F.col("_mx") + F.col("_c.i"), "_gy": F.col("_my") + F.col("_c.j")})
    found = q.withColumns({"_gx": F.floor(F.col("x") / size), "_gy": F.floor(F.col("y") / size)})
    near = found.join(moved, [*by, "_gx", "_gy"]).withColumns({"ox": F.col("x") - F.col("px"), "oy": F.col("y") - F.col("py")}).where(f"abs(ox) < {reach} and abs(oy) < {reach}")
    near = near.where(f"abs(ox - (bx + 0.5) * {bin_size}) <= {bin_size} and abs(oy - (by_ + 0.5) * {bin_size}) <= {bin_size}")
    return near.groupBy(*by, "votes").agg(F.median("ox").alias("dx"), F.median("oy").alias("dy"), F.count("*").alias("n_near"))


#: Expected right positions within the first round's radius; the radius grows by GROWTH from round to round.
FIRST, GROWTH = 2.0, 4.0


def rounds(right: DataFrame, cell: list[Column], area: float, radius: float) -> list[float]:
    """Radii for `nearest_in_rounds`, the last one `radius`: the first holds about FIRST positions where most of them are.

    `cell` deals the right positions to cells of `area`; one row of counts comes to the driver.
    """
    n = right.groupBy(*cell).agg(F.count("*").cast("double").alias("_n")).agg(F.sum(F.col("_n") * F.col("_n")) / F.sum("_n")).first()[0]
    first = math.sqrt(FIRST * area / (math.pi * n)) if n else radius
    return [radius / GROWTH**k for k in range(max(0, math.floor(math.log(radius / first, GROWTH))) if radius > first else 0, -1, -1)]


def nearest_in_rounds(left: DataFrame, right: DataFrame, by: tuple[str, ...], axes: tuple[tuple[str, str], ...], distance: Column, radii: list[tuple[float, float]], last: bool = False) -> DataFrame:
    """by, left_id, right_id and distance: for each left position the nearest right one within the last radius.

    A round joins the left positions that have none yet with the right ones on a grid, so a position with near neighbours never meets the
    far ones. `radii` has each round's radius and how far, at most, two positions within it are apart on one axis; cells are twice
    as wide, and a left position goes to the two on each axis that hold all within reach. `axes` has the names of left
    and right coordinates. Of equally near ones the smallest id counts, or the largest (`last`).
    """
    own, sign = [a for a, _ in axes], -1 if last else 1
    kind = f"struct<d: double, id: {right.schema['right_id'].dataType.simpleString()}>"
    rows = left.withColumn("_best", F.lit(None).cast(kind))
    grid = [f"_g{k}" for k in range(len(axes))]
    for radius, apart in radii:
        size = 2 * apart * (1 + 1e-9)
        r = right.withColumns({g: F.floor(F.col(b) / size) for g, (_, b) in zip(grid, axes, strict=True)})
        low = [F.floor(F.col(a) / size - 0.5) for a in own]
        cells = F.array(*[F.struct(*[(c + (k >> i & 1)).alias(g) for i, (g, c) in enumerate(zip(grid, low, strict=True))]) for k in range(1 << len(axes))])
        # Positions that have their nearest take no cell: the last coordinate is null, the first deals them out.
        none = F.array(F.struct(F.xxhash64("left_id").alias(grid[0]), *[F.lit(0 if g != grid[-1] else None).cast("long").alias(g) for g in grid[1:]]))
        q = rows.withColumn("_c", F.explode(F.when(F.col("_best").isNull(), cells).otherwise(none))).select("*", "_c.*").drop("_c")
        q, r = q.withColumnsRenamed({c: f"_l{c}" for c in (*by, *grid)}), r
        met = F.lit(True)
        for c in (*by, *grid):
            met = met & (q[f"_l{c}"] == r[c])
        found = q.join(r, met & (distance <= radius), "left").withColumn("_d", F.when(F.col("right_id").isNotNull(), F.struct((distance * sign).alias("d"), F.col("right_id").alias("id"))))
        best = (F.max if last else F.min)(F.coalesce("_best", "_d")).alias("_best")
        rows = found.groupBy(*[F.col(f"_l{c}").alias(c) for c in by], "left_id", *own).agg(best)
    one = rows.where("_best is not null").groupBy(*by, "left_id").agg((F.max if last else F.min)("_best").alias("_best"))
    return one.select(*by, "left_id", F.col("_best.id").alias("right_id"), (F.col("_best.d") * sign).alias("distance"))


def nearest_pixel(left: DataFrame, right: DataFrame, by: tuple[str, ...], reach: float = 8.0, last: bool = False) -> DataFrame:
    """by, left_id, right_id and distance: for each left position (by, id, x, y) the nearest right one within `reach`.

    Of equally near ones the smallest id counts, or the largest (`last`); positions without one give no row. See `nearest_in_rounds`.
    """
    r = right.select(*by, F.col("id").alias("right_id"), F.col("x").alias("_rx"), F.col("y").alias("_ry"))
    q = left.select(*by, F.col("id").alias("left_id"), "x", "y")
    away = F.sqrt((F.col("x") - F.col("_rx")) * (F.col("x") - F.col("_rx")) + (F.col("y") - F.col("_ry")) * (F.col("y") - F.col("_ry")))
    radii = rounds(r, [*map(F.col, by), F.floor(F.col("_rx") / reach), F.floor(F.col("_ry") / reach)], reach * reach, reach)
    return nearest_in_rounds(q, r, by, (("x", "_rx"), ("y", "_ry")), away, [(v, v) for v in radii], last)


def recovery(rows: DataFrame, level: str, station: str, truth: str, recovered: Column) -> DataFrame:
    """level, station and n, hits, share: per station, and for `any` station by truth id."""
    r = rows.select(F.col(level).alias("level"), F.col(station).alias("station"), F.col(truth).alias("truth"), recovered.alias("hit"))
    each = r.groupBy("level", "station").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("hits"))
    any_ = r.groupBy("level", "truth").agg(F.bool_or("hit").alias("hit")).groupBy("level").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("hits"))
    both = each.unionByName(any_.select("level", F.lit("any").alias("station"), "n", "hits"))
    return both.withColumn("share", F.col("hits") / F.col("n"))


def subset_sums(rows: DataFrame, subsets: dict[str, tuple[str, ...]], station: str, by: tuple[str, ...], flux: str, err: str) -> DataFrame:
    """by, subset, flux, flux_err, snr: inverse-variance sums over each named set of stations.

    Rows are partially summed by station first, so sets share one shuffle of the rows.
    """
    w = 1 / (F.col(err) * F.col(err))
    parts = rows.where(F.col(err) > 0).groupBy(*by, station).agg(F.sum(w * F.col(flux)).alias("_wf"), F.sum(w).alias("_w"))
    sets = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, members)).alias("members")) for name, members in subsets.items()])
    member = parts.withColumn("_s", F.explode(F.filter(sets, lambda s: F.array_contains(s["members"], F.col(station)))))
    sums = member.groupBy(*by, F.col("_s.name").alias("subset")).agg(F.sum("_wf").alias("_wf"), F.sum("_w").alias("_w"))
    return sums.select(*by, "subset", (F.col("_wf") / F.col("_w")).alias("flux"), (1 / F.sqrt("_w")).alias("flux_err"), (F.col("_wf") / F.sqrt("_w")).alias("snr"))


def compare_tiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """npix and the agreement of two tile sets: common valid pixels, shares below 1e-3 and 1e-2, median, largest, valid in one only.

    Tiles of one set only have null statistics and `side` a or b.
    """
    left, right = a.select("npix", "x", "y", F.col("value").alias("va"), F.lit(1).alias("ina")), b.select("npix", "x", "y", F.col("value").alias("vb"), F.lit(1).alias("inb"))
    both = left.join(right, ["npix", "x", "y"], "full").withColumn("d", F.abs(F.col("va") - F.col("vb")))
    valid = F.count("d")
    return both.groupBy("npix").agg(
        F.when(F.max("ina").isNull(), "b").when(F.max("inb").isNull(), "a").otherwise("both").alias("side"),
        valid.alias("n_common"), F.try_divide(F.sum((F.col("d") < 1e-3).cast("double")), valid.cast("double")).alias("share_1e3"),
        F.try_divide(F.sum((F.col("d") < 1e-2).cast("double")), valid.cast("double")).alias("share_1e2"), F.median("d").alias("median_diff"), F.max("d").alias("max_diff"),
        F.sum((F.col("va").isNotNull() & F.col("vb").isNull()).cast("long")).alias("only_a"), F.sum((F.col("vb").isNotNull() & F.col("va").isNull()).cast("long")).alias("only_b"),
    )
