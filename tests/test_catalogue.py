"""Neighbours, discs and cones against plain loops, and what a cone reads of a table laid out by cell."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import healpix as hp
from tessella.operators import catalogue, polygons
from tessella.operators import coverage as cov


def directions(ra, dec):
    a, d = np.radians(ra), np.radians(dec)
    return np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], -1)


def scattered(n, seed):
    r = np.random.default_rng(seed)
    z = np.r_[r.uniform(-1, 1, n), np.sin(np.radians(r.uniform(86, 90, n // 10))), -np.sin(np.radians(r.uniform(86, 90, n // 10)))]
    return r.uniform(0, 360, len(z)), np.degrees(np.arcsin(z))


@pytest.mark.parametrize("order", [0, 1, 3])
def test_neighbours_share_corners(spark, order):
    cells = np.arange(hp.npix(order))
    at = defaultdict(set)
    for k, corners in enumerate(np.round(polygons.outline(cells, order, 1), 7) + 0.0):
        for c in corners:
            at[tuple(c)].add(k)
    want = {(a, b) for group in at.values() for a in group for b in group if a != b}
    got = {tuple(r) for r in hp.with_neighbours(spark.range(hp.npix(order)).withColumnRenamed("id", "npix"), order).collect()}
    assert got == want


def test_neighbours_of_fine_cells_are_mutual(spark):
    order = 18
    first = [0, hp.npix(order) - 1, (1 << 36) - 1, 5 << 36, (5 << 36) + 123456789]
    near = hp.with_neighbours(spark.createDataFrame([(p,) for p in first], "npix long"), order).collect()
    back = {tuple(r) for r in hp.with_neighbours(spark.createDataFrame([(r["neighbour"],) for r in near], "npix long").distinct(), order).collect()}
    assert all((r["neighbour"], r["npix"]) in back for r in near) and len(near) >= 5 * 7
    assert hp.with_neighbours(spark.createDataFrame([(None,), (-1,), (hp.npix(2),)], "npix long"), 2).count() == 0


@pytest.mark.parametrize("radius", [0.05, 0.9, 4.0])
def test_nearest_equals_all_pairs_at_any_radius(spark, radius):
    (a, d), (b, e) = scattered(1500, 1), scattered(1500, 2)
    rows = lambda x, y: spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(zip(x, y, strict=True))], "id long, ra double, dec double")
    got = {r["left_id"]: (r["right_id"], r["separation"]) for r in cov.nearest(rows(a, d), rows(b, e), 5, radius).collect()}
    p, q = directions(a, d), directions(b, e)
    chord = np.linalg.norm(p[:, None] - q[None], axis=2)
    sep = np.degrees(2 * np.arcsin(np.minimum(chord / 2, 1)))
    want = {i: (int(sep[i].argmin()), sep[i].min()) for i in range(len(a)) if sep[i].min() <= radius}
    assert {i: r for i, (r, _) in got.items()} == {i: r for i, (r, _) in want.items()} and len(want) > 5
    assert all(abs(got[i][1] - want[i][1]) < 1e-9 for i in want)


def test_disc_ranges_hold_the_disc(spark):
    r = np.random.default_rng(5)
    for ra, dec, radius in ((0, 0, 1), (359.99, 89.9, 3), (45, -41.8, 0.01), (10, -89.99, 0.5), (200, 41.8, 30), (7, 7, 180)):
        ranges = polygons.disc_ranges(ra, dec, radius, 10)
        assert 1 <= len(ranges) <= 32 and all(a <= b for a, b in ranges) and all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:]))
        p = directions(np.array([ra]), np.array([dec]))[0]
        e = np.array([-np.sin(np.radians(ra)), np.cos(np.radians(ra)), 0.0])
        n, off, turn = np.cross(p, e), np.radians(radius) * r.choice([1 - 1e-9, r.uniform()], 400), r.uniform(0, 2 * np.pi, 400)
        q = np.cos(off)[:, None] * p + np.sin(off)[:, None] * (np.cos(turn)[:, None] * e + np.sin(turn)[:, None] * n)
        points = spark.createDataFrame([(float(np.degrees(np.arctan2(v[1], v[0]))), float(np.degrees(np.arcsin(v[2])))) for v in q], "ra double, dec double")
        cells = [c["npix"] for c in hp.with_cell(points, 10).collect()]
        assert all(any(a <= c <= b for a, b in ranges) for c in cells)
    assert sum(b - a + 1 for a, b in polygons.disc_ranges(45, -41.8, 0.01, 12)) < hp.npix(12) / 1000


def test_a_cone_reads_few_row_groups(spark, tmp_path):
    ra, dec = scattered(60_000, 3)
    stars = spark.createDataFrame([(i, float(a), float(d)) for i, (a, d) in enumerate(zip(ra, dec, strict=True))], "star_id long, ra double, dec double")
    path = str(tmp_path / "stars")
    spark.conf.set("parquet.block.size", 1 << 16)
    try:
        catalogue.write_by_cell(stars, path, 8)
    finally:
        spark.conf.unset("parquet.block.size")
    table = catalogue.read_by_cell(spark, path)
    for at in ((120.0, 15.0, 3.0), (0.1, 89.5, 2.0), (300.0, -30.0, 0.5)):
        found = catalogue.cone(table, *at, 8)
        got = {r["star_id"] for r in found.collect()}
        sep = np.degrees(2 * np.arcsin(np.linalg.norm(directions(ra, dec) - directions(at[0], at[1]), axis=1) / 2))
        assert got == {int(i) for i in np.flatnonzero(sep <= at[2])}
        plan = found._jdf.queryExecution().executedPlan()
        scan = plan.collectLeaves().head()
        assert "PushedFilters" in scan.toString() and "npix" in scan.toString().split("PushedFilters")[1]
        assert scan.metrics().apply("numOutputRows").value() < table.count() / 4


def test_reference_stars_of_a_band(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 15.0, 16.0, 0.02), (2, 13.9, 14.0, nan), (3, nan, 20.0, None), (4, None, 20.1, 0.01), (5, 19.0, inf, 0.1), (6, 18.0, 17.0, -0.2), (7, 18.0, 17.0, inf)]
    stars = spark.createDataFrame(rows, "id long, gmag double, rmag double, e_rmag double")
    take = lambda band: {r["id"]: (r["mag"], r["mag_err"]) for r in catalogue.reference_stars(stars, band).collect()}
    assert take("R") == take("V") == {1: (16.0, 0.02), 2: (14.0, 0.05), 3: (20.0, 0.05), 6: (17.0, 0.05), 7: (17.0, 0.05)}
    assert take("B") == {1: (15.0, 0.01), 5: (19.0, 0.01), 6: (18.0, 0.01), 7: (18.0, 0.01)}
    assert take("z") == take("H") == {}
    mixed = stars.withColumn("band", F.when(F.col("id") == 1, "g").when(F.col("id") == 3, "r"))
    assert {r["id"]: r["mag"] for r in catalogue.reference_stars(mixed, F.col("band")).collect()} == {1: 15.0, 3: 20.0}
    assert set(catalogue.reference_stars(stars, "r", (14.0, 16.5)).select("id").toPandas()["id"]) == {1, 2}


def test_nearest_on_the_sky_in_rounds(spark):
    """A dense field, lone stars, the poles and the seam against all pairs."""
    g = np.random.default_rng(4)
    dense = [(40 + a, 10 + b) for a, b in g.uniform(-0.5, 0.5, (600, 2))]
    sky = [(a, d) for a, d in zip(g.uniform(0, 360, 300), np.degrees(np.arcsin(g.uniform(-1, 1, 300))), strict=True)]
    polar = [(a, s * 89.5) for a in range(0, 360, 45) for s in (-1, 1)] + [(0.01, 0.0), (359.99, 0.0)]
    rows = [(i, float(a), float(d)) for i, (a, d) in enumerate(dense + sky + polar)]
    g.shuffle(rows)
    s = spark.createDataFrame([(int(i), float(a), float(d)) for i, a, d in rows], "id long, ra double, dec double")
    for radius in (2.0, 30.0):
        got = {r["left_id"]: r["separation"] for r in cov.nearest(s.where("id % 2 = 0"), s.where("id % 2 = 1"), 3, radius).collect()}
        ids, a, d = np.array([int(r[0]) for r in rows]), np.radians([r[1] for r in rows]), np.radians([r[2] for r in rows])
        v = np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], -1)
        odd = ids % 2 == 1
        sep = {int(i): float(np.degrees(2 * np.arcsin(np.minimum(np.linalg.norm(v[odd] - p, axis=1) / 2, 1))).min()) for i, p in zip(ids[~odd], v[~odd], strict=True)}
        want = {i: x for i, x in sep.items() if x <= radius}
        assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_first_round_is_as_fine_as_the_positions_are_dense(spark):
    from tessella.operators import measure

    r = spark.range(40_000).select((F.col("id") % 200).alias("_rx"), F.floor(F.col("id") / 200).alias("_ry"), F.col("id").alias("right_id"))
    radii = measure.rounds(r, [F.floor(F.col("_rx") / 200), F.floor(F.col("_ry") / 200)], 40_000.0, 200.0)
    assert radii[-1] == 200.0 and 0.5 < radii[0] < 4 and all(b == 4 * a for a, b in zip(radii, radii[1:], strict=False))


def test_cones_by_band_equal_all_pairs_filtered_later(spark):
    g = np.random.default_rng(6)
    stars = spark.createDataFrame([(i, float(a), float(d), float(m) if i % 7 else float("nan"), float(m) - 0.6, 0.02 * (i % 3)) for i, (a, d, m) in enumerate(zip(g.uniform(0, 360, 800), np.degrees(np.arcsin(g.uniform(-1, 1, 800))), g.uniform(13, 21, 800), strict=True))], "star_id int, ra double, dec double, gmag double, rmag double, e_rmag double")
    at = spark.createDataFrame([(k, "VgRHx"[k % 5], float(a), float(d), float(5 * (k % 4))) for k, (a, d) in enumerate(zip(g.uniform(0, 360, 60), g.uniform(-90, 90, 60), strict=True))], "target_id int, band string, ra double, dec double, radius double")
    late = catalogue.reference_stars(at.crossJoin(stars.withColumnsRenamed({"ra": "star_ra", "dec": "star_dec"})).withColumn("separation", hp.separation("ra", "dec", "star_ra", "star_dec")).where("separation <= radius"), F.col("band"))
    known = at.withColumn("letter", catalogue.letter_of(F.col("band"))).where("letter is not null")
    early = catalogue.cones(known, catalogue.by_band(stars), "radius", 3, by=("letter",))
    key = lambda d: {(r["target_id"], r["star_id"], round(r["separation"], 9), r["mag"], r["mag_err"]) for r in d.collect()}
    assert key(early) == key(late) and early.count() == len(key(late)) > 50
