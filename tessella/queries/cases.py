"""Queries over whole runs: builds, epochs, forced photometry, differencing, injection, and small parts of them."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text, wcs
from ..functions import healpix as hp
from ..operators import coverage as cov
from ..operators import detect, measure, tilestate
from ..plans import build, transients
from ..sources import index as ix
from .grid import COVERAGE_SQL, r6
from .measures import shift_vote
from .pixels import px
from .sky import FRAMES, PIXELS, SQL, STARS, WCS, ang2pix_sql, compress_sql, cover_sql, frames, pix2ang_sql, pix2sky_sql, query, scratch, sky2pix_sql, stars, table


def r4(c):
    return F.round(c, 4)


# Builds ------------------------------------------------------------------------------------------------------------

VECTOR_FRAMES = f"""{FRAMES}, vframes AS (SELECT image_id, station, 8 AS width, 8 AS height, crval1, crval2, 4.5::DOUBLE AS crpix1, 4.5::DOUBLE AS crpix2, -1.5::DOUBLE AS cd1_1, 0.0::DOUBLE AS cd1_2, 0.0::DOUBLE AS cd2_1, 1.5::DOUBLE AS cd2_2,
  list_transform(embedding, lambda v: CASE WHEN NOT isnan(v) THEN v::DOUBLE END) AS pixels FROM frames JOIN embeddings ON vec_id = image_id)"""


def vector_frames(spark, sf):
    """Frames that carry a vector as 8 x 8 pixels of 1.5 degrees."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("pixels"))
    wide = {"width": F.lit(8), "height": F.lit(8), "crpix1": F.lit(4.5), "crpix2": F.lit(4.5), "cd1_1": F.lit(-1.5), "cd2_2": F.lit(1.5)}
    return frames(spark, sf).select("image_id", "station", *WCS).withColumns(wide).join(e, "image_id")


def bilinear_sql(relation: str, keep: str, w: int) -> str:
    """SQL that adds the value of `pixels` at (px, py) to a relation of frames w pixels wide and high; blanks take the first that is none."""
    at = lambda i, j: f"pixels[(iy_ + {j}) * {w} + ix_ + {i} + 1]"
    return f"""(SELECT {keep}, coalesce(a_, n_) * (1 - fx_) * (1 - fy_) + coalesce(b_, n_) * fx_ * (1 - fy_) + coalesce(c_, n_) * (1 - fx_) * fy_ + coalesce(e_, n_) * fx_ * fy_ AS value FROM (
 SELECT *, coalesce(a_, b_, c_, e_) AS n_ FROM (SELECT *, {at(0, 0)} AS a_, {at(1, 0)} AS b_, {at(0, 1)} AS c_, {at(1, 1)} AS e_, cx_ - ix_ AS fx_, cy_ - iy_ AS fy_ FROM (
 SELECT *, floor(cx_)::BIGINT AS ix_, floor(cy_)::BIGINT AS iy_ FROM (SELECT *, least(greatest(px, 0.0::DOUBLE), {w} - 1.001::DOUBLE) AS cx_, least(greatest(py, 0.0::DOUBLE), {w} - 1.001::DOUBLE) AS cy_ FROM {relation}
 WHERE px >= -0.5 AND py >= -0.5 AND px < {w - 0.5} AND py < {w - 0.5})))))"""


SAMPLES_SQL = f"""{VECTOR_FRAMES}, vcells AS MATERIALIZED (SELECT npix >> 6 AS tile, npix & 63 AS k, ra, dec FROM {pix2ang_sql('(SELECT range AS npix FROM range(12288))', 5)}),
 vplaced AS (SELECT * FROM {sky2pix_sql('(SELECT tile, k, ra, dec, f.* FROM vcells JOIN vframes f ON dec BETWEEN crval2 - 10 AND crval2 + 10)', 'image_id, station, tile, k, pixels')} WHERE px BETWEEN -1 AND 8 AND py BETWEEN -1 AND 8),
 samples AS (SELECT image_id, station, tile AS npix, {compress_sql('(k >> 1)', 3)}::INT AS x, (7 - {compress_sql('k', 3)})::INT AS y, value, (CASE WHEN px >= 6.5 AND px < 7 THEN 0.5 ELSE 1.0 END * CASE WHEN py >= 6.5 AND py < 7 THEN 0.5 ELSE 1.0 END)::DOUBLE AS weight
  FROM {bilinear_sql('vplaced', 'image_id, station, tile, k, px, py', 8)} WHERE value IS NOT NULL)"""

COMBINED = {
    "mean": "avg(value)", "weighted": "sum(value * weight) / sum(weight)", "fading": "sum(value * weight) / sum(weight)", "add": "sum(value)", "first": "arg_min(value, image_id)",
}


def _above(tiles: str) -> str:
    half = "4 * {} + {} // 2"
    return f"""(SELECT npix >> 2 AS npix, ({half.format('((npix & 3) >> 1)', 'x')})::INT AS x, ({half.format('(1 - (npix & 1))', 'y')})::INT AS y, avg(value) AS value FROM {tiles}
 WHERE npix >> 2 IN (SELECT npix >> 2 FROM {tiles} GROUP BY 1 HAVING count(DISTINCT npix) = 4) GROUP BY ALL)"""


#: The pyramid of `build_tiles`, which `pixels` registers.
SQL["build_tiles"] = f"""WITH {SAMPLES_SQL}, t2 AS MATERIALIZED (SELECT npix, x, y, {COMBINED['weighted']} AS value FROM samples GROUP BY ALL), t1 AS MATERIALIZED {_above('t2')}, t0 AS {_above('t1')}
 SELECT 2 AS "order", npix, x, y, round(value, 4) AS value FROM t2 UNION ALL SELECT 1, npix, x, y, round(value, 4) FROM t1 UNION ALL SELECT 0, npix, x, y, round(value, 4) FROM t0"""


def _overlay_query(overlay: str, width: str):
    def run(spark, sf):
        options = build.Options(order=2, tile_width=8, overlay=overlay)
        tiles = build.wide_tiles(vector_frames(spark, sf), options) if width == "arrays" else build.build(vector_frames(spark, sf), options)[2]
        return tiles.select("npix", F.col("x").cast("int").alias("x"), "y", r4("value").alias("value"))

    run.__name__ = f"build_{overlay}_{width}"
    run.__doc__ = f"Order-2 tiles put together by the overlay {overlay}, with tiles kept as {width}."
    query(f"WITH {SAMPLES_SQL} SELECT npix, x, y, round({COMBINED[overlay]}, 4) AS value FROM samples GROUP BY ALL")(run)


for _overlay in COMBINED:
    for _width in ("rows", "arrays"):
        _overlay_query(_overlay, _width)


@query(f"WITH {SAMPLES_SQL} SELECT station, npix, x, y, round({COMBINED['weighted']}, 4) AS value FROM samples GROUP BY ALL")
def epoch_builds(spark, sf):
    """One build for each station's frames, in one job."""
    f = vector_frames(spark, sf)
    tiles = build.epoch_builds(f.select("image_id", "station"), f, ("station",), build.Options(order=2, tile_width=8))
    return tiles.select("station", "npix", "x", "y", r4("value").alias("value"))


@query(f"WITH {SAMPLES_SQL}, t AS (SELECT station, npix, x, y FROM samples GROUP BY ALL) SELECT station, count(DISTINCT npix) AS n_tiles, count(*) AS n_pixels FROM t GROUP BY station")
def epoch_tile_counts(spark, sf):
    """Tiles and pixels that each station's build has."""
    f = vector_frames(spark, sf)
    return build.tile_counts(build.epoch_builds(f.select("image_id", "station"), f, ("station",), build.Options(order=2, tile_width=8)), ("station",))


@query(f"WITH {SAMPLES_SQL} SELECT npix, x, y, round({COMBINED['weighted']}, 4) AS value FROM samples GROUP BY ALL")
def tile_state(spark, sf):
    """Additive state after three batches, one of them delivered twice and one with sources that are known: equal to a build."""
    f = vector_frames(spark, sf).withColumn("version", F.lit("1"))
    path, third = scratch(spark, "tile-state"), F.pmod(F.xxhash64("image_id"), F.lit(3))
    for part, chosen in enumerate((third == 0, third == 1, third == 1, third >= 1)):
        tilestate.merge(path, f.where(chosen), 2, 8, (0, 1, 1, 2)[part])
    tiles = tilestate.tiles_of(tilestate.sums(spark, path, 8)).select("npix", F.posexplode("pixels").alias("k", "value")).where(~F.isnan("value"))
    return tiles.select("npix", (F.col("k") % 8).alias("x"), F.floor(F.col("k") / 8).cast("int").alias("y"), r4("value").alias("value"))


# Positions -----------------------------------------------------------------------------------------------------------

WIDE = 16
WIDE_FRAMES = f"""{FRAMES}, {STARS}, wframes AS (SELECT image_id, date_obs, station, 16 AS width, 16 AS height, crval1, crval2, 8.5::DOUBLE AS crpix1, 8.5::DOUBLE AS crpix2, -0.8::DOUBLE AS cd1_1, 0.0::DOUBLE AS cd1_2, 0.0::DOUBLE AS cd2_1, 0.8::DOUBLE AS cd2_2,
  list_transform(range(256), lambda i: (100 + ((i % 16) * 7 + (i // 16) * 13 + image_id * 3) % 11 + CASE WHEN ((i % 16) * 5 + (i // 16) * 3 + image_id) % 17 = 0 THEN 500 ELSE 0 END)::DOUBLE) AS pixels FROM frames),
 wcover AS MATERIALIZED (SELECT image_id, npix FROM {cover_sql('wframes', 'image_id', 3, 16, 0.8)}),
 targets AS (SELECT s_suppkey AS target_id, (s_suppkey * 29.7713::DOUBLE) - 360.0::DOUBLE * floor(s_suppkey * 29.7713::DOUBLE / 360.0::DOUBLE) AS ra, (s_suppkey * 17.3171::DOUBLE) - 160.0::DOUBLE * floor(s_suppkey * 17.3171::DOUBLE / 160.0::DOUBLE) - 80.0::DOUBLE AS dec FROM supplier)"""


def wide_frames(spark, sf):
    """A frame of 16 x 16 pixels of 0.8 degrees per order, with a value by rule in every pixel."""
    wide = {"width": F.lit(WIDE), "height": F.lit(WIDE), "crpix1": F.lit(8.5), "crpix2": F.lit(8.5), "cd1_1": F.lit(-0.8), "cd2_2": F.lit(0.8)}

    def value(i):
        x, y = i % WIDE, F.floor(i / WIDE)
        return (100 + (x * 7 + y * 13 + F.col("image_id") * 3) % 11 + F.when((x * 5 + y * 3 + F.col("image_id")) % 17 == 0, 500).otherwise(0)).cast("double")

    return frames(spark, sf).select("image_id", "date_obs", "station", *WCS).withColumns(wide).withColumn("pixels", F.transform(F.sequence(F.lit(0), F.lit(WIDE * WIDE - 1)), value))


def targets(spark, sf):
    """A position per supplier."""
    turn = lambda x, m: x - m * F.floor(x / m)
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(key.alias("target_id"), turn(key * 29.7713, 360.0).alias("ra"), (turn(key * 17.3171, 160.0) - 80.0).alias("dec"))


PHOTOMETRY_SQL = f"""{WIDE_FRAMES}, both_ AS (SELECT -target_id - 1 AS star_id, ra, dec FROM targets UNION ALL SELECT star_id, ra, dec FROM stars WHERE mag BETWEEN 14 AND 20),
 spots AS (SELECT image_id, star_id, px AS x0, py AS y0, pixels FROM {sky2pix_sql('(SELECT l.star_id, l.ra, l.dec, f.* FROM both_ l JOIN wframes f ON l.dec BETWEEN f.crval2 - 10 AND f.crval2 + 10)', 'image_id, star_id, pixels')} WHERE px >= 0 AND py >= 0 AND px < 16 AND py < 16),
 square AS (SELECT image_id, star_id, x0, y0, x, y, CASE WHEN x BETWEEN 0 AND 15 AND y BETWEEN 0 AND 15 THEN pixels[y * 16 + x + 1] END AS v FROM (SELECT *, round(x0)::INT - 4 + i AS x, round(y0)::INT - 4 + j AS y FROM spots, (SELECT range AS i FROM range(9)), (SELECT range AS j FROM range(9)))),
 rings AS (SELECT *, (x - x0) * (x - x0) + (y - y0) * (y - y0) AS r2 FROM square),
 sums AS (SELECT image_id, star_id, count(v) FILTER (r2 <= 2.25) AS n, sum(v) FILTER (r2 <= 2.25) AS s, median(v) FILTER (r2 BETWEEN 4 AND 9) AS sky, var_pop(v) FILTER (r2 BETWEEN 4 AND 9) AS var FROM rings GROUP BY ALL),
 flux AS (SELECT image_id, star_id, s - sky * n AS flux, sqrt(abs(s - sky * n) + n * var) AS flux_err FROM sums),
 refs AS (SELECT image_id, mag + 2.5 * log10(flux) AS o FROM flux JOIN stars USING (star_id) WHERE flux > 0),
 mid AS (SELECT image_id, median(o) AS m FROM refs GROUP BY 1), dev AS (SELECT image_id, o, abs(o - m) AS d FROM refs JOIN mid USING (image_id)),
 mad AS (SELECT image_id, median(d) AS mad FROM dev GROUP BY 1),
 zps AS (SELECT image_id, CASE WHEN count(*) >= 3 THEN median(o) END AS zp, CASE WHEN count(*) >= 3 THEN stddev_pop(o) / sqrt(count(*)) END AS zp_err, count(*) AS n_used FROM dev JOIN mad USING (image_id) WHERE d < 3 * greatest(mad, 0.05) GROUP BY 1),
 photometry AS (SELECT f.image_id, -star_id - 1 AS target_id, w.station, epoch_us(w.date_obs) / 8.64e10 + 40587.0 AS mjd, flux, flux_err, CASE WHEN flux_err <> 0 THEN flux / flux_err END AS snr, CASE WHEN flux > 0 THEN -2.5 * log10(CASE WHEN flux > 0 THEN flux END) + zp END AS mag,
  sqrt(pow(1.0857::DOUBLE * flux_err / CASE WHEN flux > 0 THEN flux END, 2) + pow(coalesce(zp_err, 0), 2)) AS mag_err, CASE WHEN flux_err > 0 THEN -2.5 * log10(CASE WHEN flux_err > 0 THEN 5 * flux_err END) + zp END AS lim_mag, zp, coalesce(n_used, 0) AS n_ref_stars, zp IS NOT NULL AS calibrated
  FROM flux f LEFT JOIN zps z ON z.image_id = f.image_id JOIN wframes w ON w.image_id = f.image_id WHERE star_id < 0)"""


def photometry(spark, sf):
    return transients.forced_photometry(targets(spark, sf), stars(spark, sf), wide_frames(spark, sf), 3, 1.5, 2.0, 3.0)


@query(f"""WITH {PHOTOMETRY_SQL} SELECT image_id, target_id, round(mjd, 5) AS mjd, round(flux, 4) AS flux, round(flux_err, 4) AS flux_err, round(snr, 4) AS snr, round(mag, 4) AS mag, round(mag_err, 4) AS mag_err, round(lim_mag, 4) AS lim_mag,
 round(zp, 4) AS zp, n_ref_stars, calibrated FROM photometry""")
def forced_photometry(spark, sf):
    """Photometry of every target in every frame that holds it, with each frame's zero point."""
    p = photometry(spark, sf)
    numbers = [r4(c).alias(c) for c in ("flux", "flux_err", "snr", "mag", "mag_err", "lim_mag", "zp")]
    return p.select("image_id", "target_id", F.round("mjd", 5).alias("mjd"), *numbers, "n_ref_stars", "calibrated")


@query(f"""WITH {PHOTOMETRY_SQL}, good AS (SELECT *, CASE WHEN flux_err > 0 THEN 1 / (flux_err * flux_err) END AS w FROM photometry)
 SELECT target_id, station, count(*) AS n, count(*) FILTER (calibrated) AS n_calibrated, round(min(mjd), 5) AS first_mjd, round(max(mjd), 5) AS last_mjd, round(min(mag), 4) AS brightest, round(max(mag), 4) AS faintest,
 round(sum(w * flux) / sum(w), 3) AS flux, round(1 / sqrt(sum(w)), 4) AS flux_err FROM good GROUP BY target_id, station""")
def station_summary(spark, sf):
    """The light curve of every target and station: its span, range and combined flux."""
    s = transients.station_summary(photometry(spark, sf), wide_frames(spark, sf))
    return s.select("target_id", "station", "n", "n_calibrated", F.round("first_mjd", 5).alias("first_mjd"), F.round("last_mjd", 5).alias("last_mjd"), r4("brightest").alias("brightest"), r4("faintest").alias("faintest"), F.round("flux", 3).alias("flux"), r4("flux_err").alias("flux_err"))


def _first_sql(name: str, condition: str) -> str:
    return f"""{name}j AS (SELECT t.target_id, t.npix, t.ra, t.dec, c.image_id AS cov_id, f.* FROM tcells t LEFT JOIN (SELECT c.* FROM wcover c JOIN wframes f USING (image_id) WHERE {condition}) c USING (npix) LEFT JOIN wframes f ON f.image_id = c.image_id),
 {name} AS (SELECT target_id, npix, count(cov_id) AS n_candidates, min(CASE WHEN px >= 0 AND py >= 0 AND px < 16 AND py < 16 THEN {{'d': date_obs, 'i': image_id, 'x': px, 'y': py}} END) AS b FROM {sky2pix_sql(name + 'j', 'target_id, npix, cov_id, date_obs, image_id')} GROUP BY ALL),
 {name}r AS (SELECT *, CASE WHEN n_candidates = 0 THEN 'no_index_hit' WHEN b IS NULL THEN 'no_source_image' ELSE 'found' END AS reason FROM {name})"""


@query(f"""WITH {WIDE_FRAMES}, tcells AS (SELECT target_id, ra, dec, npix FROM {ang2pix_sql('targets', 3)}), {_first_sql('ep', 'image_id % 2 = 0')}, {_first_sql('rf', 'image_id % 2 = 1')},
 pairs AS (SELECT e.target_id, e.b.i AS image_id, e.b.x AS x0, e.b.y AS y0, r.b.i AS reference_id FROM epr e JOIN rfr r USING (target_id) WHERE e.b IS NOT NULL AND r.b IS NOT NULL),
 cut AS (SELECT p.target_id, p.reference_id, x, y, CASE WHEN x BETWEEN 0 AND 15 AND y BETWEEN 0 AND 15 THEN f.pixels[y * 16 + x + 1] END AS v, f.* EXCLUDE (pixels) FROM (SELECT *, round(x0)::INT - 4 + i AS x, round(y0)::INT - 4 + j AS y FROM pairs, (SELECT range AS i FROM range(9)), (SELECT range AS j FROM range(9))) p JOIN wframes f USING (image_id)),
 sky AS (SELECT * FROM {pix2sky_sql('cut', 'target_id, reference_id, x, y, v')}),
 back AS (SELECT * FROM {sky2pix_sql('(SELECT s.target_id, s.x, s.y, s.v, s.ra, s.dec, f.* FROM sky s JOIN wframes f ON f.image_id = s.reference_id)', 'target_id, x, y, v, pixels')}),
 d AS (SELECT target_id, x, y, v - value AS d FROM {bilinear_sql('back', 'target_id, x, y, v', 16)} WHERE v - value IS NOT NULL),
 m AS (SELECT target_id, median(d) AS background FROM d GROUP BY 1), r AS (SELECT target_id, x, y, background, d - background AS d FROM d JOIN m USING (target_id)),
 g AS (SELECT target_id, any_value(background) AS background, 1.4826::DOUBLE * median(abs(d)) AS mad, stddev_pop(d) AS sd, sum(d) AS signal, count(*) AS n, max({{'d': d, 'ny': -y, 'nx': -x}}) AS p FROM r GROUP BY 1),
 st AS (SELECT *, greatest(CASE WHEN mad > 0 THEN mad ELSE sd END, 1e-6) AS sigma FROM g)
 SELECT e.target_id, e.b.i AS image_id, r.b.i AS reference_id, CASE WHEN e.reason <> 'found' THEN e.reason WHEN r.reason <> 'found' THEN 'reference_' || r.reason ELSE 'found' END AS reason,
  st.n, round(st.background, 4) AS background, round(st.sigma, 4) AS sigma, round(st.p.d, 4) AS peak, (-st.p.nx)::INT AS peak_x, (-st.p.ny)::INT AS peak_y, round(st.signal, 3) AS signal, round(st.signal / (st.sigma * sqrt(st.n)), 4) AS snr, (st.signal / (st.sigma * sqrt(st.n)) >= 5.0)::INT AS recovered
 FROM epr e JOIN rfr r USING (target_id) LEFT JOIN st ON st.target_id = e.target_id""")
def difference_query(spark, sf):
    """Every target in the first even frame that holds it, less the first odd one, reprojected."""
    f = wide_frames(spark, sf)
    d = transients.difference_query(targets(spark, sf), f.where("image_id % 2 = 0"), f.where("image_id % 2 = 1"), 3, "date_obs", radius=4)
    return d.select("target_id", "image_id", "reference_id", "reason", "n", r4("background").alias("background"), r4("sigma").alias("sigma"), r4("peak").alias("peak"), "peak_x", "peak_y", F.round("signal", 3).alias("signal"), r4("snr").alias("snr"), F.col("recovered").cast("int").alias("recovered"))


# Noise, injection, placement -----------------------------------------------------------------------------------------


def normal_sql(*parts: str, seed: int = 42) -> str:
    """SQL of `simulate.hash_normal`."""
    digest = f"md5(concat_ws('|', {', '.join(f'({p})::VARCHAR' for p in parts)}, '{seed}'))"
    unit = lambda start: f"((('0x' || substr({digest}, {start}, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)"
    return f"(sqrt(-2 * ln({unit(1)})) * cos(2 * pi() * {unit(14)}))"


def unit_sql(*parts: str, seed: int = 42) -> str:
    digest = f"md5(concat_ws('|', {', '.join(f'({p})::VARCHAR' for p in parts)}, '{seed}'))"
    return f"((('0x' || substr({digest}, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)"


def peak_sql(relation: str, by: str) -> str:
    """SQL of by and peak_snr over differences d."""
    return f"""(SELECT {by}, max(d) / greatest(CASE WHEN 1.4826 * median(abs(d)) > 0 THEN 1.4826 * median(abs(d)) ELSE stddev_pop(d) END, 1e-6) AS peak_snr FROM (
 SELECT {by}, d - median(d) OVER (PARTITION BY {by}) AS d FROM {relation} WHERE d IS NOT NULL) GROUP BY {by})"""


STATIONS = {"A": 1.0, "B": 1.5, "C": 2.5}
STATIONS_SQL = "(VALUES ('A', 1.0::DOUBLE), ('B', 1.5::DOUBLE), ('C', 2.5::DOUBLE)) s(station, rms)"

SQL["noisy_tiles"] = f"WITH {PIXELS} SELECT npix, x, y, round(value + 0.5 * {normal_sql('npix', 'x', 'y')}, 6) AS value FROM px"

SQL["injection_recovery_table"] = f"""WITH {PIXELS}, mid AS (SELECT npix, (max(x) + min(x)) / 2.0::DOUBLE AS x0, (max(y) + min(y)) / 2.0::DOUBLE AS y0, var_pop(value) * count(*) AS v, ([3, 5, 7, 10, 20, 50])[floor({unit_sql('npix')} * 6)::INT + 1] AS level FROM px GROUP BY npix),
 truth AS (SELECT npix, x0, y0, level, (level * level + sqrt(pow(level, 4) + 4 * level * level * v)) / 2 AS flux FROM mid),
 seen AS (SELECT px.npix, station, x, y, flux / (2 * pi() * 1.96) * exp(-((x - x0) * (x - x0) + (y - y0) * (y - y0)) / (2 * 1.96)) + rms * {normal_sql('px.npix', 'station', 'x', 'y')} AS d FROM px JOIN truth USING (npix), {STATIONS_SQL} WHERE value IS NOT NULL),
 found AS (SELECT npix, station, level, peak_snr >= 5 AS hit FROM {peak_sql('seen', 'npix, station')} JOIN truth USING (npix)),
 t AS (SELECT level, station, count(*) AS n, count(*) FILTER (hit) AS hits FROM found GROUP BY ALL UNION ALL SELECT level, 'any', count(*), count(*) FILTER (hit) FROM (SELECT level, npix, bool_or(hit) AS hit FROM found GROUP BY ALL) GROUP BY level),
 w AS (SELECT *, hits / n AS share, (hits / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) AS centre, 1.96 * sqrt(hits / n * (1 - hits / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n) AS half FROM t)
 SELECT level, station, n, hits, round(share, 6) AS share, round(greatest(centre - half, 0), 6) AS low, round(least(centre + half, 1), 6) AS high FROM w"""

SQL["separated_peaks"] = f"""WITH RECURSIVE {PIXELS}, ranked AS MATERIALIZED (SELECT npix, x, y, row_number() OVER (PARTITION BY npix ORDER BY value DESC NULLS LAST, y, x) AS rank FROM px),
 r AS (SELECT npix, 0::BIGINT AS k, []::STRUCT(rank BIGINT, x INT, y INT)[] AS kept FROM (SELECT DISTINCT npix FROM px)
  UNION ALL SELECT r.npix, k + 1, CASE WHEN len(list_filter(kept, lambda p: (p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y) < 9)) = 0 THEN list_append(kept, {{'rank': n.rank, 'x': n.x, 'y': n.y}}) ELSE kept END FROM r JOIN ranked n ON n.npix = r.npix AND n.rank = k + 1)
 SELECT npix AS image_id, u.rank::INT AS rank, u.x AS x, u.y AS y FROM (SELECT npix, unnest(kept) AS u FROM r WHERE k = 64)"""


@query(f"""WITH {PIXELS}, seen AS (SELECT npix, station, trial, x, y, rms * {normal_sql('npix', 'station', 'trial', 'x', 'y')} AS d FROM px, {STATIONS_SQL}, (SELECT range::INT AS trial FROM range(1, 4)) WHERE value IS NOT NULL)
 SELECT station, trial, count(*) AS n, count(*) FILTER (peak_snr >= 3) AS false_hits, round(count(*) FILTER (peak_snr >= 3) / count(*), 6) AS rate FROM {peak_sql('seen', 'npix, station, trial')} GROUP BY ALL""")
def false_positive_run(spark, sf):
    """Detections above three deviations in images that hold noise alone, by station and trial."""
    tiles = px(spark, sf).select(F.col("npix").alias("image_id"), "x", "y", "value")
    return transients.false_positive_run(tiles, STATIONS, 3, threshold=3.0).withColumn("rate", r6("rate"))


@query(f"""WITH {PIXELS}, m AS (SELECT npix, median(value) AS m FROM px GROUP BY 1), s AS (SELECT npix, any_value(m) AS m, 1.4826::DOUBLE * median(abs(value - m)) AS s FROM px JOIN m USING (npix) GROUP BY 1)
 SELECT npix, x, y, round(value, 6) AS value FROM px JOIN s USING (npix) WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 AND abs(value - m) < 1.5 * s""")
def background_pixels(spark, sf):
    """Pixels near the background and off the edges, where test sources may be placed."""
    return measure.background_like(px(spark, sf), ("npix",), 8, 8, 1.5, 1).withColumn("value", r6("value"))


@query(f"""WITH {PIXELS}, d AS (SELECT a.npix, a.x, a.y, a.value - b.value AS v FROM px a JOIN px b ON b.npix = (a.npix + 1) % (SELECT max(npix) + 1 FROM px) AND b.x = a.x AND b.y = a.y), q AS (SELECT *, (x - 3.4::DOUBLE) * (x - 3.4::DOUBLE) + (y - 3.7::DOUBLE) * (y - 3.7::DOUBLE) AS r2 FROM d),
 s AS (SELECT npix, count(v) FILTER (r2 <= 2.25) AS n, sum(v) FILTER (r2 <= 2.25) AS s, median(v) FILTER (r2 BETWEEN 4 AND 9) AS sky, var_pop(v) FILTER (r2 BETWEEN 4 AND 9) AS var FROM q GROUP BY 1)
 SELECT npix, n AS n_pixels, round(sky, 5) AS sky, round(s - sky * n, 5) AS flux, round(sqrt(abs(s - sky * n) + n * var), 5) AS flux_err, round((s - sky * n) / sqrt(abs(s - sky * n) + n * var), 5) AS snr FROM s""")
def target_difference_photometry(spark, sf):
    """An aperture at a fixed position on each tile less the tile before it in a ring of all tiles."""
    p = px(spark, sf).select("npix", "x", "y", "value")
    last = F.broadcast(p.agg(F.max("npix").alias("_last")))  # one row
    reference = p.crossJoin(last).select(F.when(F.col("npix") == 0, F.col("_last")).otherwise(F.col("npix") - 1).alias("npix"), "x", "y", "value")
    d = measure.difference_photometry(p, reference, ("npix",), 3.4, 3.7, 1.5, 2.0, 3.0)
    five = lambda c: F.round(c, 5).alias(c)
    return d.select("npix", "n_pixels", five("sky"), five("flux"), five("flux_err"), five("snr"))


# Index and headers -----------------------------------------------------------------------------------------------------


@query(f"WITH {FRAMES}, {COVERAGE_SQL}, k AS (SELECT npix, image_id, ((row_number() OVER (PARTITION BY npix ORDER BY image_id) - 1) // 2)::INT AS pass FROM cover) SELECT npix, pass, count(*) AS n_sources, min(image_id) AS first_source FROM k GROUP BY ALL")
def image_passes(spark, sf):
    """Each tile's frames in slices of two."""
    return cov.image_passes(cov.coverage(frames(spark, sf), 6), 2)


@query(f"""WITH {STARS}, five AS (SELECT DISTINCT npix FROM {ang2pix_sql('stars', 5)}), eight AS (SELECT DISTINCT npix FROM {ang2pix_sql('stars', 8)})
 SELECT 8 AS "order", npix, '/hips/Norder8/Dir' || ((npix // 10000) * 10000)::VARCHAR || '/Npix' || npix::VARCHAR || '.fits' AS path FROM eight""")
def highest_tiles(spark, sf):
    """Tile files of the highest order among files of two orders and others that are no tiles."""
    s = stars(spark, sf)
    tiles = [hp.with_cell(s, o).select(F.concat(F.lit("/hips/"), hp.tile_path(F.lit(o), "npix")).alias("path")).distinct() for o in (5, 8)]
    others = table(spark, sf, "nation").select(F.concat(F.lit("/hips/Norder9/readme"), F.col("n_nationkey").cast("string"), F.lit(".txt")).alias("path"))
    return ix.highest_tiles(tiles[0].unionByName(tiles[1]).unionByName(others))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN -32 ELSE 16 END AS bitpix, CASE WHEN p_size % 3 = 0 THEN 0.0 ELSE p_size * 10 END::DOUBLE AS bzero, CASE WHEN p_size % 5 = 0 THEN 1.0 ELSE 0.25 END::DOUBLE AS bscale, CASE WHEN p_size % 7 <> 0 THEN -32768 END::DOUBLE AS blank FROM part""")
def header_defaults(spark, sf):
    """Pixel format and scaling from reference headers, with what is missing filled in."""
    size = F.col("p_size")
    card = lambda key, value, missing: F.when(size % missing != 0, F.rpad(F.concat(F.lit(f"{key:<8}= "), value), 80, " "))
    header = F.concat_ws("\n", card("BITPIX", F.lit("16"), 4), card("BZERO", F.concat((size * 10).cast("string"), F.lit(".0 / offset")), 3), card("BSCALE", F.lit("0.25"), 5), card("BLANK", F.lit("-32768"), 7))
    p = table(spark, sf, "part").select("p_partkey", header.alias("header"))
    return p.select("p_partkey", *[c.alias(k) for k, c in text.pixel_defaults("header").items()])


@query(f"""WITH v AS ({SQL['shift_vote']}), {FRAMES} SELECT image_id, round(crpix1 + coalesce(dx, 0), 4) AS crpix1, round(crpix2 + coalesce(dy, 0), 4) AS crpix2 FROM frames LEFT JOIN v ON field = image_id % 30""")
def shifted_frames(spark, sf):
    """Frames whose reference pixel moves by the shift that their field's vote gives."""
    f = frames(spark, sf).withColumn("field", F.col("image_id") % 30)
    moved = wcs.shifted(f, shift_vote(spark, sf), "field")
    return moved.select("image_id", r4("crpix1").alias("crpix1"), r4("crpix2").alias("crpix2"))


@query("""SELECT 'orders' AS kind, o_orderkey AS id, o_orderpriority AS priority, NULL::DOUBLE AS value FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT event_type, event_id, NULL, round(value, 4) FROM events WHERE value > 50""")
def candidate_tables(spark, sf):
    """Two candidate tables as one CSV text with the union of their columns, read back by its schema."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.lit("orders").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))
    e = table(spark, sf, "events").where("value > 50").select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), r4("value").alias("value"))
    rows = ix.union_of([o, e])
    line = rows.select(F.to_csv(F.struct("kind", "id", "priority", "value")).alias("line"))
    return line.select(F.from_csv("line", "kind string, id long, priority string, value double").alias("r")).select("r.*")


@query(f"""WITH {STARS}, d AS (SELECT field, star_id, row_number() OVER (PARTITION BY field ORDER BY star_id) AS k, ra, dec FROM stars), a AS (SELECT field, star_id AS a_id, ra AS ax, dec AS ay FROM d WHERE k % 2 = 0), b AS (SELECT field, star_id AS b_id, ra AS bx, dec AS by_ FROM d WHERE k % 2 = 1),
 p AS (SELECT field, a_id, b_id, sqrt((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_)) AS dist FROM a JOIN b USING (field) WHERE abs(ax - bx) <= 40 AND abs(ay - by_) <= 40) SELECT field, a_id AS left_id, arg_min(b_id, dist) AS right_id, round(min(dist), 5) AS distance FROM p WHERE dist <= 40 GROUP BY ALL""")
def nearest_detection(spark, sf):
    """For every second position of a field the nearest of the others within 40 pixels; of equally near ones the last, as in the SQL on one thread."""
    k = F.row_number().over(Window.partitionBy("field").orderBy("star_id"))
    s = stars(spark, sf).select("field", F.col("star_id").alias("id"), F.col("ra").alias("x"), F.col("dec").alias("y"), (k % 2).alias("side"))
    n = measure.nearest_pixel(s.where("side = 0").drop("side"), s.where("side = 1").drop("side"), ("field",), 40.0, last=True)
    return n.select("field", "left_id", "right_id", F.round("distance", 5).alias("distance"))


# Detection -------------------------------------------------------------------------------------------------------------

_KERNEL = [math.exp(-(k * k) / (2 * 1.2 * 1.2)) for k in range(-5, 6)]
_KERNEL = [w / sum(_KERNEL) for w in _KERNEL]
DETECTION_SQL = f"""spots AS (SELECT DISTINCT c_nationkey AS field, c_custkey * 37 % 96 AS x, c_custkey * 53 % 96 AS y, 1 AS hit FROM customer WHERE c_custkey % 6 < 4),
 raw AS (SELECT field, x, y, ((x * 7 + y * 13 + field * 3) % 11 + CASE WHEN hit IS NULL THEN 0 ELSE 500 + (x * 3 + y * 5) % 97 END)::DOUBLE AS v FROM (SELECT field, x, y FROM (SELECT DISTINCT c_nationkey AS field FROM customer), (SELECT range AS x FROM range(96)), (SELECT range AS y FROM range(96))) LEFT JOIN spots USING (field, x, y)),
 kernel AS (SELECT range - 5 AS k, ({_KERNEL}::DOUBLE[])[range + 1] AS w FROM range(11)),
 rows_ AS (SELECT a.field, a.x, a.y, sum(b.v * w) AS v FROM (SELECT field, x, y, k, w, greatest(least(x + k, 95), 0) AS bx FROM raw, kernel) a JOIN raw b ON b.field = a.field AND b.x = a.bx AND b.y = a.y GROUP BY ALL),
 soft AS MATERIALIZED (SELECT a.field, a.x, a.y, round(sum(b.v * w), 9) AS v FROM (SELECT field, x, y, k, w, greatest(least(y + k, 95), 0) AS by_ FROM rows_, kernel) a JOIN rows_ b ON b.field = a.field AND b.x = a.x AND b.y = a.by_ GROUP BY ALL),
 limits AS (SELECT field, median(v) + 3 * stddev_pop(v) AS high FROM soft GROUP BY 1),
 tops AS (SELECT * FROM (SELECT *, max(r) OVER (PARTITION BY field, x ORDER BY y RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM (SELECT *, max(v) OVER (PARTITION BY field, y ORDER BY x RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS r FROM soft)) JOIN limits USING (field) WHERE v = m AND v > high),
 found AS MATERIALIZED (SELECT field, x, y FROM tops QUALIFY row_number() OVER (PARTITION BY field ORDER BY v DESC, y, x) <= 250),
 places AS (SELECT c_nationkey AS field, c_custkey AS id, c_custkey * 37 % 96 - (c_nationkey % 7 - 3) * 1.3::DOUBLE + (c_custkey % 3 - 1) * 0.25::DOUBLE AS x, c_custkey * 53 % 96 + (c_nationkey % 5 - 2) * 2.1::DOUBLE AS y FROM customer WHERE c_custkey % 5 < 4),
 inner_ AS (SELECT * FROM places WHERE x > 6 AND y > 6 AND x < 90 AND y < 90),
 votes AS (SELECT field, floor(ox / 4 + 0.5)::BIGINT AS bx, floor(oy / 4 + 0.5)::BIGINT AS by_, count(*) AS votes FROM (SELECT p.field, f.x - p.x AS ox, f.y - p.y AS oy FROM found f JOIN inner_ p USING (field)) WHERE abs(ox) < 40 AND abs(oy) < 40 GROUP BY ALL),
 winner AS (SELECT field, bx * 4.0::DOUBLE AS cx, by_ * 4.0::DOUBLE AS cy, votes FROM votes QUALIFY row_number() OVER (PARTITION BY field ORDER BY votes DESC, bx, by_) = 1),
 near AS (SELECT field, id, ox, oy FROM (SELECT p.field, p.id, f.x - p.x AS ox, f.y - p.y AS oy, f.x, f.y, sqrt(pow(f.x - p.x - cx, 2) + pow(f.y - p.y - cy, 2)) AS d FROM inner_ p JOIN winner USING (field) JOIN found f USING (field)) WHERE d < 8 QUALIFY row_number() OVER (PARTITION BY field, id ORDER BY d, y, x) = 1),
 fine AS (SELECT field, median(ox) AS fx, median(oy) AS fy, count(*) AS n FROM near GROUP BY 1)"""


@query(f"""WITH {DETECTION_SQL} SELECT r.field, round(coalesce(CASE WHEN n >= 3 THEN fx ELSE cx END, 0), 4) AS dx, round(coalesce(CASE WHEN n >= 3 THEN fy ELSE cy END, 0), 4) AS dy, coalesce(votes, 0) AS votes, coalesce(n, 0) AS n_matched, coalesce(n >= 3, false) AS refined
 FROM (SELECT DISTINCT field FROM raw) r LEFT JOIN winner USING (field) LEFT JOIN fine USING (field)""")
def catalogue_shift(spark, sf):
    """Sources of every field's image, smoothed, against the places a catalogue predicts: vote, then refine."""
    c, size = table(spark, sf, "customer"), 96
    key, field = F.col("c_custkey"), F.col("c_nationkey")
    spot = F.when(key % 6 < 4, (key * 53 % size) * size + key * 37 % size)
    spots = c.groupBy(field.alias("field")).agg(F.collect_set(spot).alias("spots"))  # pixels of a field at most

    def value(i):
        x, y = i % size, F.floor(i / size)
        return ((x * 7 + y * 13 + F.col("field") * 3) % 11 + F.when(F.array_contains("spots", i.cast("long")), 500 + (x * 3 + y * 5) % 97).otherwise(0)).cast("double")

    images = spots.select("field", F.lit(size).alias("width"), F.lit(size).alias("height"), F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), value).alias("pixels"))
    places = c.where(key % 5 < 4).select(field.alias("field"), key.alias("id"), (key * 37 % size - (field % 7 - 3) * 1.3 + (key % 3 - 1) * 0.25).alias("x"), (key * 53 % size + (field % 5 - 2) * 2.1).alias("y"))
    s = detect.catalogue_shift(images, places, ("field",), reach=40.0, border=6.0)
    return s.select("field", r4("dx").alias("dx"), r4("dy").alias("dy"), "votes", "n_matched", "refined")
