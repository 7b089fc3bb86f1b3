"""Exact coverage: no position of a frame lies in a cell that is missing, and cells that a frame doesn't meet are few."""

import numpy as np
import pytest

from tessella.functions import healpix as hp
from tessella.operators import coverage as cov
from tessella.operators import polygons

SCHEMA = "image_id long, width int, height int, crval1 double, crval2 double, crpix1 double, crpix2 double, cd1_1 double, cd1_2 double, cd2_1 double, cd2_2 double"


def frames_of(kind, n, seed=3):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        scale, turn, w, h = 10 ** r.uniform(-3.5, -1.2), r.uniform(0, 2 * np.pi), int(r.integers(5, 90)), int(r.integers(5, 90))
        ra, dec = r.uniform(0, 360), np.degrees(np.arcsin(r.uniform(-1, 1)))
        if kind == "polar":
            dec = r.choice([-1, 1]) * (90 - 10 ** r.uniform(-3, 0.3))
        elif kind == "seam":
            ra = r.choice([0.0, 359.999, 0.001, 90.0, 180.0])
        elif kind == "level":
            turn = 0.0
        c, s = scale * np.cos(turn), scale * np.sin(turn)
        out.append((i, w, h, float(ra), float(dec), w / 2 + float(r.uniform(-3, 3)), h / 2, float(-c), float(s), float(s), float(c)))
    return out


def sky(rows, x, y):
    """Unit vectors of pixel (x, y) of each row."""
    w = {c: np.array([r[k] for r in rows], float) for k, c in enumerate(("image_id", *polygons.WCS))}
    t, e, n = polygons._tangent(w)
    u, v = x + 1 - w["crpix1"], y + 1 - w["crpix2"]
    p = t + np.radians(w["cd1_1"] * u + w["cd1_2"] * v)[:, None] * e + np.radians(w["cd2_1"] * u + w["cd2_2"] * v)[:, None] * n
    return p / np.linalg.norm(p, axis=1, keepdims=True), w


@pytest.mark.parametrize("kind", ["level", "turned", "polar", "seam"])
def test_every_position_of_a_frame_is_covered(spark, kind):
    rows = frames_of(kind, 60)
    frames = spark.createDataFrame(rows, SCHEMA)
    r = np.random.default_rng(9)
    points = []
    for _ in range(150):
        fx, fy = r.choice([0.0, 1.0, r.uniform()]), r.uniform()  # corners and edges among them
        p, w = sky(rows, 0, 0)
        p, _ = sky(rows, fx * w["width"] - (fx == 1.0) * 1e-9 - 0.5 * (fx == 0.0), fy * w["height"])
        points.extend((i, float(np.degrees(np.arctan2(q[1], q[0]))), float(np.degrees(np.arctan2(q[2], np.hypot(q[0], q[1]))))) for i, q in enumerate(p))
    for order in (0, 3, 6, 9):
        cells = {(c["image_id"], c["npix"]) for c in cov.coverage(frames, order).collect()}
        found = hp.with_cell(spark.createDataFrame(points, "image_id long, ra double, dec double"), order).select("image_id", "npix").distinct().collect()
        assert {(c["image_id"], c["npix"]) for c in found} <= cells
        assert len(cells) == cov.coverage(frames, order).count()


def test_stars_in_frames_equal_all_pairs(spark):
    rows = frames_of("turned", 80, 5) + [(1000 + i, *r[1:]) for i, r in enumerate(frames_of("polar", 40, 6))] + [(2000 + i, *r[1:]) for i, r in enumerate(frames_of("seam", 40, 7))]
    r = np.random.default_rng(1)
    z = np.r_[r.uniform(-1, 1, 20_000), np.sin(np.radians(r.uniform(87, 90, 3000))), -np.sin(np.radians(r.uniform(87, 90, 3000)))]
    ra, dec = r.uniform(0, 360, len(z)), np.degrees(np.arcsin(z))
    stars = spark.createDataFrame([(i, float(a), float(d)) for i, (a, d) in enumerate(zip(ra, dec, strict=True))], "star_id long, ra double, dec double")
    p = np.stack([np.cos(np.radians(dec)) * np.cos(np.radians(ra)), np.cos(np.radians(dec)) * np.sin(np.radians(ra)), np.sin(np.radians(dec))], -1)
    want = set()
    for row in rows:
        w = {c: np.array([row[k]], float) for k, c in enumerate(("image_id", *polygons.WCS))}
        t, e, n = (v[0] for v in polygons._tangent(w))
        facing = p @ t
        xi, eta = np.degrees(p @ e / facing), np.degrees(p @ n / facing)
        det = row[7] * row[10] - row[8] * row[9]
        x, y = (row[10] * xi - row[8] * eta) / det + row[5] - 1, (row[7] * eta - row[9] * xi) / det + row[6] - 1
        want |= {(row[0], int(i)) for i in np.flatnonzero((facing > 1e-10) & (x >= 0) & (y >= 0) & (x < row[1]) & (y < row[2]))}
    frames = spark.createDataFrame(rows, SCHEMA)
    for order in (4, 7, 9):
        got = {(s["image_id"], s["star_id"]) for s in cov.stars_in_frames(frames, stars, order).collect()}
        assert got == want and len(want) > 300


def test_few_cells_too_many(spark):
    """Against dense samples: what a frame's own positions don't hit is met by its margin or by a sliver."""
    rows = frames_of("turned", 40, 11)
    order, frames = 8, spark.createDataFrame(rows, SCHEMA)
    got = {(c["image_id"], c["npix"]) for c in cov.coverage(frames, order).collect()}
    step = np.linspace(-1.5, 1.0, 61)  # with the margin
    points = []
    for fx in step:
        for fy in step:
            _, w = sky(rows, 0, 0)
            p, _ = sky(rows, (fx + 1.5) / 2.5 * (w["width"] + 1) - 1, (fy + 1.5) / 2.5 * (w["height"] + 1) - 1)
            points.extend((i, float(np.degrees(np.arctan2(q[1], q[0]))), float(np.degrees(np.arctan2(q[2], np.hypot(q[0], q[1]))))) for i, q in enumerate(p))
    hit = {(c["image_id"], c["npix"]) for c in hp.with_cell(spark.createDataFrame(points, "image_id long, ra double, dec double"), order).select("image_id", "npix").distinct().collect()}
    assert hit <= got and len(got - hit) <= 0.03 * len(got) + 8


def test_frames_that_cover_nothing_and_keys_of_any_type(spark):
    rows = [(1, 64, 64, 10.0, 10.0, 32.0, 32.0, 0.0, 0.0, 0.0, 0.0), (2, 0, 64, 10.0, 10.0, 32.0, 32.0, 0.01, 0.0, 0.0, 0.01), (3, 64, 64, None, 10.0, 32.0, 32.0, 0.01, 0.0, 0.0, 0.01), (4, 64, 64, 10.0, 10.0, 32.0, 32.0, 0.01, 0.01, 0.01, 0.01), (5, 64, 64, 10.0, 10.0, 32.0, 32.0, 0.01, 0.0, 0.0, 0.01)]
    frames = spark.createDataFrame(rows, SCHEMA)
    assert {c["image_id"] for c in cov.coverage(frames, 5).collect()} == {5}
    named = frames.selectExpr("named_struct('a', image_id, 'b', 'x') AS image_id", *polygons.WCS)
    assert cov.coverage(named, 5).where("image_id.a = 5").count() == cov.coverage(frames, 5).count() > 0
    assert cov.coverage(frames.limit(0), 5).count() == 0


def test_descent_runs_in_slices(spark, monkeypatch):
    frames = spark.createDataFrame(frames_of("turned", 50, 13), SCHEMA)
    whole = {(c["image_id"], c["npix"]) for c in cov.coverage(frames, 7).collect()}
    monkeypatch.setattr(polygons, "PAIRS", 100)
    w = {c: np.array([r[k] for r in frames_of("turned", 50, 13)], float) for k, c in enumerate(("image_id", *polygons.WCS))}
    parts = list(polygons._slices(w, 7))
    assert len(parts) > 5 and sum(s.stop - s.start for s in parts) == 50
    got = set()
    for s in parts:
        at, pix, _ = polygons.covered({c: v[s] for c, v in w.items()}, 7)
        got |= {(int(a + s.start), int(p)) for a, p in zip(at, pix, strict=True)}
    assert got == whole


def test_coverage_of_wide_frames_keeps_few_pairs_in_memory():
    import tracemalloc

    r, n, one = np.random.default_rng(2), 4000, np.ones(4000)
    w = {"width": 16 * one, "height": 16 * one, "crval1": r.uniform(0, 360, n), "crval2": r.uniform(-80, 80, n), "crpix1": 8.5 * one, "crpix2": 8.5 * one, "cd1_1": -0.8 * one, "cd1_2": 0 * one, "cd2_1": 0 * one, "cd2_2": 0.8 * one}
    tracemalloc.start()
    at, pix, boxes = polygons.covered(w, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6 and len(boxes) == len(at)
    cells = polygons.covered(w, 3, boxes=False)
    assert set(zip(at.tolist(), pix.tolist(), strict=True)) == set(zip(*[c.tolist() for c in cells[:2]], strict=True)) and len(cells[0]) == len(at)


def test_first_frame_by_rank_equals_all_frames_tried(spark):
    """More frames than are tried at once, equal and missing ranks, positions off all frames and without a cell; no pair becomes a row."""
    from pyspark.sql import functions as F

    from tessella.functions import wcs

    rows = frames_of("level", 1, 4) * 40 + frames_of("turned", 30, 5)
    frames = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], SCHEMA).withColumn("date", F.when(F.col("image_id") % 9 != 8, F.col("image_id") * 7 % 5))
    r = np.random.default_rng(2)
    centres = [(x[3] + r.uniform(-2, 2), x[4] + r.uniform(-2, 2)) for x in rows for _ in range(6)]
    spots = [(i, float(a), float(d)) for i, (a, d) in enumerate(centres) if abs(d) < 90] + [(9000, None, 1.0), (9001, 1.0, 95.0)]
    targets = spark.createDataFrame(spots, "target_id int, ra double, dec double")
    found = cov.first_covering_frame(targets, frames, 4, "date")
    got = {t["target_id"]: (t["image_id"], t["n_candidates"], t["reason"]) for t in found.collect()}
    x, y = wcs.sky2pix("ra", "dec", wcs.wcs_of())
    placed = targets.crossJoin(frames).withColumns({"x": x, "y": y}).where(wcs.inside("x", "y", "width", "height"))
    want = {t["target_id"]: t["m"][1] for t in placed.groupBy("target_id").agg(F.min(F.struct("date", "image_id")).alias("m")).collect()}
    assert len(got) == len(spots) and {k: v[0] for k, v in got.items() if v[0] is not None} == want and len(want) > 20
    counts = {c["npix"]: c["count"] for c in cov.coverage(frames, 4).groupBy("npix").count().collect()}
    assert all(n == counts.get(t["npix"], 0) for t in found.collect() for n in [t["n_candidates"]])
    assert got[9000][1:] == got[9001][1:] == (0, "no_index_hit") and {v[2] for v in got.values()} == {"found", "no_index_hit", "no_source_image"}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_out_of_reach_are_dropped_before_they_are_projected(spark):
    """Tangent points off the frame, a negative margin: all pairs within, and the join itself drops the others."""
    from pyspark.sql import functions as F

    from tessella.functions import wcs

    rows = [(i, *r[1:5], r[5] + (i % 3) * 60.0, r[6] - (i % 2) * 45.0, *r[7:]) for i, r in enumerate(frames_of("turned", 40, 8) + frames_of("polar", 20, 9))]
    frames = spark.createDataFrame(rows, SCHEMA)
    g = np.random.default_rng(3)
    spots = [(i, float(r[3] + g.uniform(-9, 9)), float(np.clip(r[4] + g.uniform(-6, 6), -90, 90)), 15.0) for i, r in enumerate([r for r in rows for _ in range(40)])]
    stars = spark.createDataFrame(spots, "star_id int, ra double, dec double, mag double")
    x, y = wcs.sky2pix("ra", "dec", wcs.wcs_of())
    placed = stars.crossJoin(frames).withColumns({"x": x, "y": y})
    for margin in (0.0, 2.0, -0.4):
        found = cov.stars_in_frames(frames, stars, 5, margin, ("mag",))
        got = {(r["image_id"], r["star_id"]) for r in found.collect()}
        want = {(r["image_id"], r["star_id"]) for r in placed.where(wcs.inside("x", "y", "width", "height", margin)).select("image_id", "star_id").collect()}
        assert got == want and len(want) > 20
        join = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
        assert len(join) == 1 and "_near" in join[0]
