"""Queries over pixels: sampling, co-adding, the pyramid, calibration, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.photometry import gaussian
from ..operators import images, measure, orderstats
from ..plans import build
from .grid import r6
from .sky import PIXELS, WCS, frames, query, table, tiles8


def px(spark, sf):
    """npix, telescope, x, y, value of all 8 x 8 tiles."""
    return images.unnest(tiles8(spark, sf), "pixels", 8, ("npix", "telescope"))


@query(f"WITH {PIXELS} SELECT npix, telescope, x, y, round(value, 6) AS value FROM px")
def array_unnest_pixels(spark, sf):
    """Every pixel of every tile as a row."""
    return px(spark, sf).withColumn("value", r6("value"))


@query(f"WITH {PIXELS} SELECT npix, count(value) AS n, round(sum(value * 2.5::DOUBLE + 10), 4) AS total, round(min(value * 2.5::DOUBLE + 10), 4) AS low FROM px GROUP BY npix")
def scale_and_blank(spark, sf):
    """Scaled pixels of each tile, summed."""
    t = tiles8(spark, sf).select("npix", F.explode(images.scaled("pixels", 2.5, 10.0)).alias("v"))
    return t.groupBy("npix").agg(F.count("v").alias("n"), F.round(F.sum("v"), 4).alias("total"), F.round(F.min("v"), 4).alias("low"))


@query(f"""WITH {PIXELS} SELECT a.npix, a.x, a.y, round((a.value * 0.7 + b.value * 0.3) * 0.6 + (c.value * 0.7 + d.value * 0.3) * 0.4, 5) AS value FROM px a
 JOIN px b ON b.npix = a.npix AND b.x = a.x + 1 AND b.y = a.y JOIN px c ON c.npix = a.npix AND c.x = a.x AND c.y = a.y + 1 JOIN px d ON d.npix = a.npix AND d.x = a.x + 1 AND d.y = a.y + 1""")
def bilinear_shift(spark, sf):
    """Every tile sampled 0.3 pixels to the right and 0.4 down."""
    t = tiles8(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(48))))
    t = t.select("npix", "pixels", (F.col("k") % 7).alias("x"), F.floor(F.col("k") / 7).cast("int").alias("y"))
    t = images.with_bilinear(t.withColumns({"u": F.col("x") + 0.3, "v": F.col("y") + 0.4}), "pixels", "u", "v", F.lit(8), F.lit(8))
    return t.select("npix", "x", "y", F.round("value", 5).alias("value"))


SAMPLES = f"{PIXELS}, s AS (SELECT telescope, x, y, value, npix AS rank, (CASE WHEN x >= 6.5 AND x < 7 THEN 0.5 ELSE 1 END) * (npix % 5 + 1)::DOUBLE AS weight FROM px)"


def samples(spark, sf):
    return px(spark, sf).select("telescope", "x", "y", "value", F.col("npix").alias("rank"), (images.edge_weight(F.col("x"), F.col("y"), 8, 8) * (F.col("npix") % 5 + 1)).alias("weight"))


def _coadd(spark, sf, overlay):
    c = images.coadd(samples(spark, sf), ("telescope", "x", "y"), overlay)
    return c.select("telescope", "x", "y", F.round("value", 5).alias("value"), "n_samples")


@query(f"WITH {SAMPLES} SELECT telescope, x, y, round(avg(value), 5) AS value, count(value) AS n_samples FROM s GROUP BY ALL")
def coadd_mean(spark, sf):
    """Mean of all tiles of a telescope."""
    return _coadd(spark, sf, "mean")


@query(f"WITH {SAMPLES} SELECT telescope, x, y, round(sum(value * weight) / sum(CASE WHEN value IS NOT NULL THEN weight END), 5) AS value, count(value) AS n_samples FROM s GROUP BY ALL")
def coadd_fading(spark, sf):
    """Weighted mean of all tiles of a telescope."""
    return _coadd(spark, sf, "fading")


@query(f"WITH {SAMPLES} SELECT telescope, x, y, round(sum(value), 5) AS value, count(value) AS n_samples FROM s GROUP BY ALL")
def coadd_add(spark, sf):
    """Sum of all tiles of a telescope."""
    return _coadd(spark, sf, "add")


@query(f"WITH {SAMPLES} SELECT telescope, x, y, round(arg_min(value, rank) FILTER (value IS NOT NULL), 5) AS value, count(value) AS n_samples FROM s GROUP BY ALL")
def coadd_first(spark, sf):
    """First valid value of all tiles of a telescope."""
    return _coadd(spark, sf, "first")


@query(f"""WITH {PIXELS}, whole AS (SELECT npix >> 2 AS parent FROM embeddings e JOIN (SELECT DISTINCT npix FROM px) ON vec_id = npix GROUP BY 1 HAVING count(DISTINCT npix) = 4)
 SELECT npix >> 2 AS npix, (((npix & 3) >> 1) * 4 + x // 2)::INT AS x, ((1 - (npix & 1)) * 4 + y // 2)::INT AS y, round(avg(value), 5) AS value FROM px WHERE npix >> 2 IN (SELECT parent FROM whole) GROUP BY ALL""")
def tree_downsample(spark, sf):
    """Tiles one order up, where all four children exist."""
    return images.downsample(px(spark, sf).select("npix", "x", "y", "value"), 8).withColumn("value", F.round("value", 5))


@query(f"""WITH {PIXELS}, n AS (SELECT floor(sqrt(count(*)))::BIGINT AS across FROM embeddings)
 SELECT ((npix % across) * 4 + x // 2)::INT AS px, ((npix // across) * 4 + 3 - y // 2)::INT AS py, round(value, 6) AS value FROM px, n WHERE x % 2 = 0 AND y % 2 = 0""")
def allsky_decimate(spark, sf):
    """The preview of all tiles, thinned to four pixels a side."""
    t = px(spark, sf).select("npix", "x", "y", "value")
    n = table(spark, sf, "embeddings").count()
    return images.allsky(t, 8, 4, n).withColumn("value", r6("value"))


@query("SELECT count(l_extendedprice) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high, quantile_disc(l_extendedprice, 0.01) AS p01, quantile_disc(l_extendedprice, 0.99) AS p99 FROM lineitem")
def valid_range_auto(spark, sf):
    """Range and percentiles of all values."""
    return images.valid_range(table(spark, sf, "lineitem"), "l_extendedprice")


@query("SELECT round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem")
def stretch_percentiles(spark, sf):
    """The 5 % and 95 % points between which a picture is stretched."""
    low, high = orderstats.quantiles(table(spark, sf, "lineitem"), "l_extendedprice", [0.05, 0.95], interpolate=True)
    return spark.createDataFrame([(low, high)], "p05 double, p95 double").select(F.round("p05", 4).alias("p05"), F.round("p95", 4).alias("p95"))


@query(f"WITH {PIXELS} SELECT telescope, x, y, round(median(value), 6) AS master, round(avg(value), 6) AS mean, count(value) AS n FROM px GROUP BY ALL")
def master_median(spark, sf):
    """Median and mean stack of each telescope's frames."""
    return px(spark, sf).groupBy("telescope", "x", "y").agg(r6(F.median("value")).alias("master"), r6(F.avg("value")).alias("mean"), F.count("value").alias("n"))


@query(f"""WITH {PIXELS}, bias AS (SELECT x, y, median(value) AS b FROM px WHERE telescope = 0 GROUP BY ALL), flat0 AS (SELECT x, y, median(abs(value) + 1) AS f FROM px WHERE telescope = 1 GROUP BY ALL),
 flat AS (SELECT x, y, CASE WHEN f / (SELECT median(f) FROM flat0) < 0.1 THEN 1.0 ELSE f / (SELECT median(f) FROM flat0) END AS f FROM flat0)
 SELECT npix AS image_id, x, y, round((value - b) / f, 5) AS value FROM px JOIN bias USING (x, y) JOIN flat USING (x, y) WHERE telescope >= 2""")
def flat_fielded(spark, sf):
    """Frames less the bias of one telescope, by the normed flat of another."""
    p = px(spark, sf)
    bias = p.where("telescope = 0").groupBy("x", "y").agg(F.median("value").alias("value"))
    flat = p.where("telescope = 1").groupBy("x", "y").agg(F.median(F.abs("value") + 1).alias("value"))
    raw = p.where("telescope >= 2").select(F.col("npix").alias("image_id"), "x", "y", "value")
    return images.calibrated(raw, bias, flat).withColumn("value", F.round("value", 5))


@query(f"""WITH {PIXELS} SELECT telescope, x, y, round(median(value), 6) AS value, round(avg(npix * 0.25), 6) AS mean_mjd, sum(npix % 60)::BIGINT AS exposure FROM px GROUP BY ALL""")
def stack_median(spark, sf):
    """Median stack with mean time and total exposure."""
    return px(spark, sf).groupBy("telescope", "x", "y").agg(r6(F.median("value")).alias("value"), r6(F.avg(F.col("npix") * 0.25)).alias("mean_mjd"), F.sum(F.col("npix") % 60).alias("exposure"))


def _clip_sql(source: str, by: str, value: str, rounds: int = 3) -> str:
    out, cur = [], source
    for k in range(rounds):
        out.append(f"m{k} AS (SELECT {by}, median({value}) AS m_, stddev_pop({value}) AS s_ FROM {cur} GROUP BY {by}), k{k} AS (SELECT c.* FROM {cur} c JOIN m{k} USING ({by}) WHERE abs({value} - m_) <= 3.0 * s_)")
        cur = f"k{k}"
    return ", ".join(out)


@query(f"""WITH g AS (SELECT l_partkey % 256 AS x, l_suppkey % 64 AS y, l_extendedprice AS value, (l_partkey % 256) // 64 AS mx, (l_suppkey % 64) // 64 AS my FROM lineitem), {_clip_sql('g', 'mx, my', 'value')},
 c AS (SELECT mx, my, median(value) AS background, stddev_pop(value) AS rms, count(*) AS n FROM k2 GROUP BY ALL)
 SELECT a.mx, a.my, round(any_value(a.background), 4) AS background, round(any_value(a.rms), 4) AS rms, any_value(a.n) AS n, round(median(b.background), 4) AS smooth_background FROM c a JOIN c b ON abs(a.mx - b.mx) <= 1 AND abs(a.my - b.my) <= 1 GROUP BY a.mx, a.my""")
def bkg_mesh_clip(spark, sf):
    """Clipped background per mesh cell and its 3 x 3 median."""
    p = table(spark, sf, "lineitem").select((F.col("l_partkey") % 256).alias("x"), (F.col("l_suppkey") % 64).alias("y"), F.col("l_extendedprice").alias("value"))
    m = measure.mesh(p, 64)
    return m.select("mx", "my", F.round("background", 4).alias("background"), F.round("rms", 4).alias("rms"), "n", F.round("smooth_background", 4).alias("smooth_background"))


SURFACE_SQL = f"""{PIXELS}, holes AS (SELECT npix, x, y, CASE WHEN npix % 5 = 0 AND x < 2 AND y < 2 THEN NULL WHEN npix % 7 = 0 AND x // 2 <> y // 2 THEN NULL WHEN npix % 11 = 0 AND (x % 2 = 1 OR y % 2 = 1) THEN NULL ELSE value END AS value, x // 2 AS mx, y // 2 AS my FROM px),
 valid AS (SELECT * FROM holes WHERE value IS NOT NULL), {_clip_sql('valid', 'npix, mx, my', 'value')},
 good AS (SELECT npix, mx, my, median(value) AS b, stddev_pop(value) AS r FROM k2 JOIN (SELECT npix, mx, my FROM valid GROUP BY ALL HAVING count(*) >= 2) USING (npix, mx, my) GROUP BY ALL),
 cells AS (SELECT npix, mx, my, a, ar FROM (SELECT npix, median(b) AS a, median(r) AS ar FROM good GROUP BY 1), (SELECT range AS mx FROM range(4)), (SELECT range AS my FROM range(4))),
 filled AS (SELECT c.npix, c.mx, c.my, coalesce(any_value(g.b) FILTER (g.mx = c.mx AND g.my = c.my), median(g.b), any_value(a)) AS b, coalesce(any_value(g.r) FILTER (g.mx = c.mx AND g.my = c.my), median(g.r), any_value(ar)) AS r
  FROM cells c LEFT JOIN good g ON g.npix = c.npix AND abs(g.mx - c.mx) <= 1 AND abs(g.my - c.my) <= 1 GROUP BY ALL),
 smooth AS (SELECT c.npix, c.mx, c.my, median(f.b) AS b, median(f.r) AS r FROM cells c JOIN filled f ON f.npix = c.npix AND abs(f.mx - c.mx) <= 1 AND abs(f.my - c.my) <= 1 GROUP BY ALL),
 {_clip_sql('valid', 'npix', 'value').replace('m0 ', 'w0 ').replace('m1 ', 'w1 ').replace('m2 ', 'w2 ').replace('JOIN m', 'JOIN w').replace('k0', 'v0').replace('k1', 'v1').replace('k2', 'v2')},
 whole AS (SELECT npix, median(value) AS wb, stddev_pop(value) AS wr FROM v2 GROUP BY 1),
 spots AS (SELECT *, least(greatest((x + 0.5) / 2 - 0.5, 0), 3) AS gx, least(greatest((y + 0.5) / 2 - 0.5, 0), 3) AS gy FROM holes),
 surface AS (SELECT s.npix, s.x, s.y, s.value, sum(f.b * (1 - abs(f.mx - gx)) * (1 - abs(f.my - gy))) AS b, sum(f.r * (1 - abs(f.mx - gx)) * (1 - abs(f.my - gy))) AS r FROM spots s LEFT JOIN smooth f ON f.npix = s.npix AND abs(f.mx - gx) < 1 AND abs(f.my - gy) < 1 GROUP BY ALL)"""


@query(f"WITH {SURFACE_SQL} SELECT npix, x, y, round(value - coalesce(b, wb), 5) AS subtracted, round(coalesce(b, wb), 5) AS background, round(coalesce(r, wr), 5) AS rms, b IS NULL AS flat FROM surface LEFT JOIN whole USING (npix)")
def background_subtracted(spark, sf):
    """Tiles less a surface through 4 x 4 mesh cells; some cells have too few values, and some tiles have no good cell."""
    p, n, x, y = px(spark, sf), F.col("npix"), F.col("x"), F.col("y")
    hole = ((n % 5 == 0) & (x < 2) & (y < 2)) | ((n % 7 == 0) & (F.floor(x / 2) != F.floor(y / 2))) | ((n % 11 == 0) & ((x % 2 == 1) | (y % 2 == 1)))
    s = measure.background_surface(p.select("npix", "x", "y", F.when(~hole, F.col("value")).alias("value")), ("npix",), 8, 8, 2)
    return s.select("npix", "x", "y", F.round(F.col("value") - F.col("background"), 5).alias("subtracted"), F.round("background", 5).alias("background"), F.round("rms", 5).alias("rms"), "flat")


APERTURE = """SELECT npix, n_pixels, round(sky, 6) AS sky, round(s - sky * n_pixels, 5) AS flux, round(sqrt(abs(s - sky * n_pixels) + n_pixels * {noise}), 5) AS flux_err FROM (
 SELECT npix, count(CASE WHEN r2 <= 4 THEN value END) AS n_pixels, sum(CASE WHEN r2 <= 4 THEN value END) AS s, median(CASE WHEN r2 BETWEEN 9 AND 16 THEN value END) AS sky, var_pop(CASE WHEN r2 BETWEEN 9 AND 16 THEN value END) AS v
 FROM (SELECT *, (x - 3.5) * (x - 3.5) + (y - 3.5) * (y - 3.5) AS r2 FROM px) GROUP BY npix)"""


@query(f"WITH {PIXELS} {APERTURE.format(noise='v')}")
def aperture_flux(spark, sf):
    """Aperture photometry at every tile's centre, error from the sky's scatter."""
    a = measure.aperture(px(spark, sf), ("npix",), F.lit(3.5), F.lit(3.5), 2.0, 3.0, 4.0)
    return a.select("npix", "n_pixels", r6("sky").alias("sky"), F.round("flux", 5).alias("flux"), F.round("flux_err", 5).alias("flux_err"))


@query(f"WITH {PIXELS} {APERTURE.format(noise='abs(sky)')}")
def aperture_flux_sky_level(spark, sf):
    """Aperture photometry at every tile's centre, error from the sky's level."""
    a = measure.aperture(px(spark, sf), ("npix",), F.lit(3.5), F.lit(3.5), 2.0, 3.0, 4.0, noise="sky_level")
    return a.select("npix", "n_pixels", r6("sky").alias("sky"), F.round("flux", 5).alias("flux"), F.round("flux_err", 5).alias("flux_err"))


@query(f"""WITH {PIXELS}, d AS (SELECT a.npix, a.x, a.y, a.value - b.value AS d FROM px a JOIN px b ON b.npix = a.npix + 1 AND a.npix % 2 = 0 AND a.x = b.x AND a.y = b.y),
 m AS (SELECT npix, median(d) AS bg FROM d GROUP BY npix), r AS (SELECT d.npix, x, y, d - bg AS d, bg FROM d JOIN m USING (npix)),
 s AS (SELECT npix, any_value(bg) AS bg, greatest(CASE WHEN 1.4826 * median(abs(d)) > 0 THEN 1.4826 * median(abs(d)) ELSE stddev_pop(d) END, 1e-6) AS sigma, max(d) AS peak, max({{'d': d, 'ny': -y, 'nx': -x}}) AS top, sum(d) AS signal, count(*) AS n FROM r GROUP BY npix)
 SELECT npix, round(bg, 5) AS background, round(sigma, 5) AS sigma, round(peak, 5) AS peak, -top.nx AS peak_x, -top.ny AS peak_y, round(signal, 4) AS signal, n, round(peak / sigma, 3) AS peak_snr, signal / (sigma * sqrt(n)) >= 5 AS recovered FROM s""")
def diff_detect(spark, sf):
    """Difference statistics of each even tile and its neighbour."""
    p = px(spark, sf).select("npix", "x", "y", "value")
    d = measure.difference(p.where("npix % 2 = 0"), p.where("npix % 2 = 1").withColumn("npix", F.col("npix") - 1), ("npix",))
    return d.select("npix", F.round("background", 5).alias("background"), F.round("sigma", 5).alias("sigma"), F.round("peak", 5).alias("peak"), "peak_x", "peak_y", F.round("signal", 4).alias("signal"), "n", F.round("peak_snr", 3).alias("peak_snr"), "recovered")


@query(f"""WITH {PIXELS}, p AS (SELECT a.npix, a.x, a.y, a.value, max(b.value) AS top FROM px a JOIN px b ON a.npix = b.npix AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3 GROUP BY ALL)
 SELECT npix, x, y, round(value, 6) AS value FROM p WHERE value = top ORDER BY p.value DESC, npix, y, x LIMIT 250""")
def local_maxima_top(spark, sf):
    """The 250 brightest local maxima."""
    peaks = images.local_maxima(px(spark, sf).select("npix", "x", "y", "value"), ("npix",)).where("peak")
    return peaks.orderBy(F.desc("value"), "npix", "y", "x").limit(250).select("npix", "x", "y", r6("value").alias("value"))


@query(f"""WITH {PIXELS}, a AS (SELECT npix, x, y, value FROM px WHERE telescope <= 6), b AS (SELECT npix, x, y, CASE WHEN (npix + x) % 7 = 0 THEN NULL ELSE value + ((npix % 5) * 0.004) END AS value FROM px WHERE telescope >= 3),
 j AS (SELECT coalesce(a.npix, b.npix) AS npix, a.npix AS ia, b.npix AS ib, a.value AS va, b.value AS vb, abs(a.value - b.value) AS d FROM a FULL JOIN b ON a.npix = b.npix AND a.x = b.x AND a.y = b.y)
 SELECT npix, CASE WHEN max(ia) IS NULL THEN 'b' WHEN max(ib) IS NULL THEN 'a' ELSE 'both' END AS side, count(d) AS n_common, round(CASE WHEN count(d) > 0 THEN sum(CASE WHEN d < 0.01 THEN 1.0 ELSE 0 END) FILTER (d IS NOT NULL) / count(d) END, 6) AS share_1e2, round(median(d), 5) AS median_diff, round(max(d), 5) AS max_diff,
  count(*) FILTER (va IS NOT NULL AND vb IS NULL) AS only_a, count(*) FILTER (vb IS NOT NULL AND va IS NULL) AS only_b FROM j GROUP BY npix""")
def tileset_compare(spark, sf):
    """Agreement of two overlapping tile sets."""
    p = px(spark, sf)
    b = p.where("telescope >= 3").select("npix", "x", "y", F.when((F.col("npix") + F.col("x")) % 7 != 0, F.col("value") + (F.col("npix") % 5) * 0.004).alias("value"))
    c = measure.compare_tiles(p.where("telescope <= 6").select("npix", "x", "y", "value"), b)
    return c.select("npix", "side", "n_common", r6("share_1e2").alias("share_1e2"), F.round("median_diff", 5).alias("median_diff"), F.round("max_diff", 5).alias("max_diff"), "only_a", "only_b")


@query(f"WITH {PIXELS} SELECT a.npix, round(corr(a.value, b.value), 6) AS corr, round(avg(abs(a.value - b.value)), 6) AS mean_diff, round(max(abs(a.value - b.value)), 6) AS max_diff FROM px a JOIN px b ON b.npix = a.npix + 1 AND a.x = b.x AND a.y = b.y WHERE a.npix % 2 = 0 GROUP BY a.npix")
def tile_corr(spark, sf):
    """Correlation and differences of each even tile and its neighbour."""
    p = px(spark, sf).select("npix", "x", "y", "value")
    b = p.where("npix % 2 = 1").select((F.col("npix") - 1).alias("npix"), "x", "y", F.col("value").alias("other"))
    d = F.abs(F.col("value") - F.col("other"))
    return p.where("npix % 2 = 0").join(b, ["npix", "x", "y"]).groupBy("npix").agg(r6(F.corr("value", "other")).alias("corr"), r6(F.avg(d)).alias("mean_diff"), r6(F.max(d)).alias("max_diff"))


@query(f"WITH {PIXELS} SELECT telescope, floor(value * 10)::BIGINT AS bin, count(*) AS n FROM px WHERE value IS NOT NULL GROUP BY ALL")
def value_histogram(spark, sf):
    """Pixels per tenth of a unit."""
    return px(spark, sf).where("value is not null").groupBy("telescope", F.floor(F.col("value") * 10).alias("bin")).agg(F.count("*").alias("n"))


@query(f"WITH {PIXELS}, u AS (SELECT telescope, value FROM px GROUP BY ALL HAVING count(*) = 1) SELECT p.npix, p.x, p.y, (p.y * 8 + p.x)::BIGINT AS place FROM px p JOIN u USING (telescope, value)")
def unique_value_places(spark, sf):
    """Where values that occur once in a telescope's tiles stand."""
    p = px(spark, sf)
    once = p.groupBy("telescope", "value").count().where("count = 1").select("telescope", "value")
    return p.join(once, ["telescope", "value"]).select("npix", "x", "y", (F.col("y") * 8 + F.col("x")).cast("long").alias("place"))


@query(f"""WITH {PIXELS}, src AS (SELECT vec_id AS npix, (vec_id % 7)::DOUBLE AS x0, (vec_id % 5 + 1)::DOUBLE AS y0, (vec_id % 11 + 1) * 2.0::DOUBLE AS flux FROM embeddings)
 SELECT npix, x, y, round(value + flux / (2 * pi() * 1.96) * exp(-((x - x0) * (x - x0) + (y - y0) * (y - y0)) / 3.92), 5) AS value FROM px JOIN src USING (npix)""")
def blur_inject(spark, sf):
    """A round source of known flux added to every tile."""
    n = F.col("npix")
    source = gaussian("x", "y", n % 7, n % 5 + 1, (n % 11 + 1) * 2.0, 1.4)
    return px(spark, sf).select("npix", "x", "y", F.round(F.col("value") + source, 5).alias("value"))


@query()
def build_tiles(spark, sf):
    """A pyramid of order 3 tiles of 8 pixels from frames that carry a vector as 8 x 8 pixels of 3 degrees."""
    f = frames(spark, sf)
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("pixels"))
    wide = {"width": F.lit(8), "height": F.lit(8), "crpix1": F.lit(4.5), "crpix2": F.lit(4.5), "cd1_1": F.lit(-1.5), "cd2_2": F.lit(1.5)}
    framed = f.select("image_id", *WCS).withColumns(wide).join(e, "image_id")
    tiles = build.build(framed, build.Options(order=2, tile_width=8, tree=True))
    parts = [t.select(F.lit(o).alias("order"), "npix", "x", "y", F.round("value", 4).alias("value")) for o, t in tiles.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])

