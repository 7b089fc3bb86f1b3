"""The grid, projections and paths."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import healpix as hp
from tessella.functions import text, wcs
from tessella.plans import build


@pytest.mark.parametrize("order", [0, 1, 2, 3, 5])
def test_centres_lie_in_their_cells(spark, order):
    cells = hp.with_cell(hp.with_centre(spark.range(hp.npix(order)).withColumnRenamed("id", "npix"), order), order, out="back")
    assert cells.where("back is null or back <> npix").count() == 0


def test_parents_nest(spark):
    r = random.Random(1)
    sky = spark.createDataFrame([(r.uniform(-720, 720), math.degrees(math.asin(r.uniform(-1, 1)))) for _ in range(4000)] + [(0.0, 90.0), (10.0, -90.0), (360.0, 0.0)], "ra double, dec double")
    both = hp.with_cell(hp.with_cell(sky, 9, out="fine"), 6, out="coarse")
    assert both.where(hp.parent("fine", 3) != F.col("coarse")).count() == 0
    assert both.where("fine is null").count() == 0


def test_cells_have_equal_areas(spark):
    r = random.Random(2)
    sky = spark.createDataFrame([(r.uniform(0, 360), math.degrees(math.asin(r.uniform(-1, 1)))) for _ in range(24000)], "ra double, dec double")
    counts = [x["count"] for x in hp.with_cell(sky, 1).groupBy("npix").count().collect()]
    assert len(counts) == 48 and max(counts) < 1.3 * min(counts)


def test_bad_positions_have_no_cell(spark):
    rows = hp.with_cell(spark.createDataFrame([(1.0, 91.0), (None, 0.0), (0.0, None)], "ra double, dec double"), 3).collect()
    assert [x["npix"] for x in rows] == [None] * 3
    assert hp.with_centre(spark.createDataFrame([(-1,), (48,)], "npix long"), 1).where("ra is not null").count() == 0


def test_high_orders_round_trip(spark):
    cells = spark.createDataFrame([(k * 977_777_777_777 % hp.npix(21),) for k in range(1, 200)], "npix long")
    back = hp.with_cell(hp.with_centre(cells, 21), 21, out="back")
    assert back.where("back <> npix").count() == 0


def test_bits(spark):
    rows = spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 255, 256, 65535, (1 << 24) - 1, 0xABCDEF)], "x long")
    assert rows.where(hp.compress_bits(hp.spread_bits("x")) != F.col("x")).count() == 0
    for r in rows.select("x", hp.spread_bits("x").alias("s")).collect():
        assert r["s"] == sum((r["x"] >> k & 1) << 2 * k for k in range(24))


def test_tile_pixel_order(spark):
    grid = spark.createDataFrame([(x, y) for y in (0, 1) for x in (0, 1)], "x int, y int")
    assert [r[0] for r in grid.select(hp.xy2hpx("x", "y", 2)).collect()] == [1, 3, 0, 2]


def test_tangent_plane_round_trip(spark):
    frames = spark.createDataFrame([(ra, dec, x, y) for ra in (0.0, 359.9, 123.4) for dec in (-89.5, -30.0, 0.0, 60.0, 89.9) for x, y in ((0.0, 0.0), (63.0, 10.5), (-20.0, 80.0))], "crval1 double, crval2 double, x double, y double")
    w = {"crval1": F.col("crval1"), "crval2": F.col("crval2"), "crpix1": F.lit(32.5), "crpix2": F.lit(30.0), "cd1_1": F.lit(-0.01), "cd1_2": F.lit(0.002), "cd2_1": F.lit(0.001), "cd2_2": F.lit(0.012)}
    ra, dec = wcs.pix2sky("x", "y", w)
    sky = frames.withColumns({"ra": ra, "dec": dec})
    x, y = wcs.sky2pix("ra", "dec", w)
    assert sky.select(F.max(F.abs(x - F.col("x")) + F.abs(y - F.col("y")))).first()[0] < 1e-6


def test_behind_the_plane_and_singular_matrices_are_null(spark):
    w = {"crval1": F.lit(0.0), "crval2": F.lit(0.0), "crpix1": F.lit(1.0), "crpix2": F.lit(1.0), "cd1_1": F.lit(0.01), "cd1_2": F.lit(0.0), "cd2_1": F.lit(0.0), "cd2_2": F.lit(0.01)}
    one = spark.range(1)
    assert one.select(wcs.sky2pix(F.lit(180.0), F.lit(0.0), w)[0]).first()[0] is None
    assert one.select(wcs.sky2pix(F.lit(1.0), F.lit(0.0), w | {"cd1_1": F.lit(0.0)})[0]).first()[0] is None


def test_recommended_orders(spark):
    scales = (0.262, 0.05, 0.396, 0.258, 1.0, 2.75)
    rows = spark.createDataFrame([(s,) for s in scales], "s double").select(wcs.recommended_order("s")).collect()
    assert [r[0] for r in rows] == [12, 14, 11, 12, 10, 9]


def test_globs_and_paths(spark):
    names = spark.createDataFrame([("ab.fits",), ("a.fits",), ("b.fits",), ("ab",)], "n string")
    matches = lambda p: [r["n"] for r in names.where(text.glob_match("n", p)).collect()]
    assert matches("*.fits") == ["ab.fits", "a.fits", "b.fits"] and matches("a*") == ["ab.fits", "a.fits", "ab"]
    assert matches("ab*b.fits") == [] and matches("ab") == ["ab"]
    p = spark.createDataFrame([("/root/x/y.fits",), ("C:\\d\\z.fits",)], "p string").select(text.basename("p"), text.relative_to("p", "/root")).collect()
    assert [tuple(r) for r in p] == [("y.fits", "x/y.fits"), ("z.fits", "z.fits")]


def test_stage_policy_and_chunks():
    assert build.runs_tree(True, True, False, 5) and not build.runs_tree(True, True, True, 5) and not build.runs_tree(True, False, False, 5)
    assert not build.runs_tree(False, True, False, 5) and not build.runs_tree(True, True, False, 0)
    assert build.first_output_order(True, 7) == 0 and build.first_output_order(False, 7) == 7
    assert build.defers_preview(True, 5) and not build.defers_preview(True, 3) and not build.defers_preview(False, 5)
    assert [build.chunk_size(n, 32) for n in (0, 46, 512, 4096, 100000)] == [1, 1, 4, 32, 64]
