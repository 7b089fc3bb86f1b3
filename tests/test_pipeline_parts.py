"""Co-adding, the pyramid, appending, measuring and streaming."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import images, incremental, measure
from tessella.operators.coverage import coverage, nearest, stars_in_frames
from tessella.plans import build
from tessella.streaming import ingest

FRAME = "image_id long, width int, height int, crval1 double, crval2 double, crpix1 double, crpix2 double, cd1_1 double, cd1_2 double, cd2_1 double, cd2_2 double, pixels array<float>"


def frames(spark, values, n=12, size=12, step=1.0):
    r = random.Random(3)
    return spark.createDataFrame([(i, size, size, r.uniform(0, 360), r.uniform(-80, 80), (size + 1) / 2, (size + 1) / 2, -step, 0.0, 0.0, step, [float(values(i, k)) for k in range(size * size)]) for i in range(n)], FRAME)


def test_constant_frames_make_constant_tiles(spark):
    tiles = build.build(frames(spark, lambda i, k: 7.0), build.Options(order=2, tree=True))
    top = tiles[2].agg(F.min("value"), F.max("value"), F.count("*")).first()
    assert top[0] == pytest.approx(7) and top[1] == pytest.approx(7) and top[2] > 400
    assert tiles[1].where("abs(value - 7) > 1e-9").count() == 0


def test_order_of_frames_does_not_matter(spark):
    f = frames(spark, lambda i, k: i + k % 5)
    a = build.build(f, build.Options(order=2))[2]
    b = build.build(f.orderBy(F.desc("image_id")).repartition(3), build.Options(order=2))[2]
    assert a.join(b.withColumnRenamed("value", "v"), ["npix", "x", "y"]).where("abs(value - v) > 1e-9").count() == 0 and a.count() == b.count()


def test_append_equals_rebuild_and_is_idempotent(spark):
    f, o = frames(spark, lambda i, k: i * 3 + k % 7), build.Options(order=2)
    whole = incremental.tiles_of(incremental.accumulate(build.sample_tiles(f, o)))
    state = incremental.accumulate(build.sample_tiles(f.where("image_id < 7"), o))
    for _ in range(2):
        state = build.append(state, f.where("image_id >= 6"), o)
    got = incremental.tiles_of(state)
    assert got.count() == whole.count()
    assert got.join(whole.withColumnRenamed("value", "v"), ["npix", "x", "y"]).where("abs(value - v) > 1e-9").count() == 0


def test_append_preconditions():
    with pytest.raises(ValueError):
        incremental.append_allowed(False, True)
    with pytest.raises(ValueError):
        incremental.append_allowed(True, False)


def test_index_merge(spark):
    index = lambda rows: spark.createDataFrame(rows, "npix long, filepath string, cellmem long")
    old, new = index([(1, "a", 10), (1, "b", 20)]), index([(1, "b", 20), (1, "c", 30)])
    m = incremental.merge_index(old, new)
    assert m.count() == 3 and [r["filepath"] for r in m.where("changed").collect()] == ["c"]
    again = incremental.merge_index(m.drop("changed"), new)
    assert again.where("changed").count() == 0 and incremental.dirty_tiles(again).count() == 0


def test_dirty_tiles_only_are_rebuilt(spark):
    tiles = spark.createDataFrame([(1, 0, 0, 5.0), (2, 0, 0, 6.0)], "npix long, x int, y int, value double")
    state = spark.createDataFrame([(1, 0, 0, 9, 8.0, 2.0), (2, 0, 0, 9, 8.0, 2.0)], "npix long, x int, y int, source int, wsum double, wtot double")
    out = incremental.rebuild_dirty(tiles, state, spark.createDataFrame([(1,)], "npix long"))
    assert {r["npix"]: r["value"] for r in out.collect()} == {1: 4.0, 2: 6.0}


def pixels(spark, rows, width=2):
    return images.unnest(spark.createDataFrame(rows, "npix long, pixels array<double>"), "pixels", width, ("npix",))


def test_downsampling_needs_four_children_and_keeps_the_mean(spark):
    p = pixels(spark, [(c, [float(c * 4 + k) for k in range(4)]) for c in range(4)] + [(4, [1.0] * 4)])
    up = images.downsample(p, 2)
    assert up.count() == 4 and up.agg(F.avg("value")).first()[0] == pytest.approx(7.5)
    places = {(r["x"], r["y"]): r["value"] for r in up.collect()}
    assert places[0, 1] == pytest.approx(1.5) and places[1, 1] == pytest.approx(9.5)  # children 0 and 2
    assert images.downsample(p, 2, allow_partial=True).count() == 5
    row = {(r["x"], r["y"]): r["value"] for r in images.downsample(p, 2, layout="row").collect()}
    assert row[1, 0] == pytest.approx(5.5)


def test_blank_policies(spark):
    image = spark.createDataFrame([([1.0, float("nan"), 3.0, 4.0],)], "p array<double>").withColumns({"u": F.lit(0.5), "v": F.lit(0.5)})
    value = lambda policy: images.with_bilinear(image, "p", "u", "v", F.lit(2), F.lit(2), policy=policy).first()["value"]
    assert value("replace") == pytest.approx((1 + 1 + 3 + 4) / 4) and value("strict") is None and value("propagate") is None
    outside = images.with_bilinear(image.withColumn("u", F.lit(1.6)), "p", "u", "v", F.lit(2), F.lit(2)).first()["value"]
    assert outside is None
    with pytest.raises(ValueError):
        images.with_bilinear(image, "p", "u", "v", F.lit(2), F.lit(2), policy="other")


def test_edge_weights(spark):
    rows = spark.createDataFrame([(0.2, 3.0), (6.6, 3.0), (6.6, 6.9), (7.2, 3.0)], "x double, y double")
    assert [r[0] for r in rows.select(images.edge_weight(F.col("x"), F.col("y"), 8, 8)).collect()] == [1.0, 0.5, 0.25, 1.0]


def test_overlays(spark):
    s = spark.createDataFrame([(1, None, 1.0, 0), (1, 4.0, 3.0, 1), (1, 8.0, 1.0, 2), (2, None, 1.0, 0)], "p int, value double, weight double, rank int")
    got = {o: {r["p"]: r["value"] for r in images.coadd(s, ("p",), o).collect()} for o in images.OVERLAYS}
    assert got["mean"][1] == 6 and got["weighted"][1] == 5 and got["fading"][1] == 5 and got["first"][1] == 4 and got["add"][1] == 12
    assert all(v[2] is None for v in got.values())
    with pytest.raises(ValueError):
        images.coadd(s, ("p",), "other")


def test_clip_zero_point_and_detection(spark):
    stars = spark.createDataFrame([(1, 25 + 0.01 * k) for k in range(9)] + [(1, 30.0), (2, 25.0), (2, 25.1)], "field int, offset double")
    z = {r["field"]: r for r in measure.zero_point(stars, ("field",)).collect()}
    assert z[1]["zp"] == pytest.approx(25.04) and z[1]["n_used"] == 9 and z[2]["zp"] is None
    grid = [(x, y) for x in range(12) for y in range(12)]
    epoch = spark.createDataFrame([(1, x, y, 10.0 + (x * 7 + y * 3) % 5 * 0.1 + (900.0 if (x, y) == (4, 5) else 0)) for x, y in grid], "c int, x int, y int, value double")
    ref = spark.createDataFrame([(1, x, y, 2.0) for x, y in grid], "c int, x int, y int, value double")
    d = measure.difference(epoch, ref, ("c",)).first()
    assert (d["peak_x"], d["peak_y"]) == (4, 5) and d["recovered"] and d["background"] == pytest.approx(8.2)


def test_crossmatch_and_stars(spark):
    r = random.Random(9)
    points = [(i, r.uniform(0, 360), r.uniform(-88, 88)) for i in range(300)]
    near = [(i, (ra + 0.3) % 360, dec) for i, ra, dec in points[:150]]
    left, right = spark.createDataFrame(points, "id long, ra double, dec double"), spark.createDataFrame(near, "id long, ra double, dec double")
    got = {x["left_id"]: x["right_id"] for x in nearest(left, right, 5, 0.5).collect()}
    assert sum(got.get(i) == i for i in range(150)) >= 148
    f = frames(spark, lambda i, k: 0.0)
    stars = left.withColumnRenamed("id", "star_id")
    fast = {(x["image_id"], x["star_id"]) for x in stars_in_frames(f, stars, 4).collect()}
    from tessella.functions import wcs

    x, y = wcs.sky2pix("ra", "dec", wcs.wcs_of())
    slow = f.crossJoin(stars).withColumns({"x": x, "y": y}).where(wcs.inside("x", "y", "width", "height"))
    assert fast == {(r_["image_id"], r_["star_id"]) for r_ in slow.collect()}
    assert coverage(f.withColumn("cd1_1", F.lit(0.0)).withColumn("cd2_2", F.lit(0.0)), 4).count() == 0


def test_stream_gives_the_batch_result(spark, tmp_path):
    f = frames(spark, lambda i, k: 0.0).withColumn("date_obs", F.timestamp_micros(F.col("image_id") * 60_000_000 + 1_700_000_000_000_000)).drop("pixels")
    f.where("image_id < 6").coalesce(1).write.parquet(str(tmp_path / "in"))
    f.where("image_id >= 4").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # 4 and 5 come twice
    source = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ingest.dirty_tile_stream(source, 3).writeStream.format("memory").queryName("dirty").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r["image_id"], r["npix"]) for r in spark.table("dirty").collect()}
    assert got == {(r["image_id"], r["npix"]) for r in coverage(f, 3).collect()} and spark.table("dirty").count() == len(got)


def test_state_sink_is_idempotent(spark, tmp_path):
    sink = ingest.into_state(str(tmp_path / "s"), lambda b: b)
    batch = spark.createDataFrame([(1, 0, 0, 5, 2.0, 3.0), (1, 0, 0, 6, 4.0, 1.0)], "npix long, x int, y int, source int, value double, weight double")
    sink(batch, 0)
    sink(batch, 0)
    sink(batch.where("source = 6").withColumn("value", F.lit(8.0)), 1)
    state = spark.read.parquet(str(tmp_path / "s"))
    assert incremental.tiles_of(state).first()["value"] == pytest.approx((6 + 8) / 4)


def test_blur_noise_and_placement(spark):
    from tessella.operators import simulate

    one = spark.createDataFrame([([0.0] * 40 + [1.0] + [0.0] * 40,), (None,)], "p array<double>")
    out = one.select(simulate.blur("p", 9, 1.0).alias("b")).collect()
    assert sum(out[0]["b"]) == pytest.approx(1, abs=1e-6) and max(out[0]["b"]) == out[0]["b"][40] == pytest.approx(0.159, abs=2e-3) and out[1]["b"] is None
    noise = spark.range(20000).select(simulate.hash_normal("id", seed=3).alias("n"))
    stats = noise.agg(F.avg("n"), F.stddev("n")).first()
    assert abs(stats[0]) < 0.03 and abs(stats[1] - 1) < 0.03
    rows = [(1, 0, 0.0, 0.0), (1, 1, 3.0, 0.0), (1, 2, 6.0, 0.0), (2, 0, 1.0, 1.0)]
    kept = simulate.keep_apart(spark.createDataFrame(rows, "image_id long, rank int, x double, y double"), "image_id", 5.0)
    assert sorted((r["image_id"], r["rank"]) for r in kept.collect()) == [(1, 0), (1, 2), (2, 0)]


def test_forced_photometry_recovers_magnitudes(spark):
    from tessella.functions import wcs
    from tessella.operators import simulate
    from tessella.plans import transients

    size, step = 60, 0.01
    frame = frames(spark, lambda i, k: 0.0, n=1, size=size, step=step).withColumn("date_obs", F.lit("2024-01-01").cast("timestamp"))
    r = random.Random(7)
    spots = [(k, 9.0 + 14 * (k % 4) + r.random(), 9.0 + 14 * (k // 4) + r.random(), 15 + 0.2 * k) for k in range(12)]
    placed = spark.createDataFrame(spots, "star_id long, px double, py double, mag double").crossJoin(frame.select("crval1", "crval2", "crpix1", "crpix2", "cd1_1", "cd1_2", "cd2_1", "cd2_2"))
    ra, dec = wcs.pix2sky("px", "py", wcs.wcs_of())
    stars = placed.select("star_id", ra.alias("ra"), dec.alias("dec"), "mag", "px", "py")
    flux = F.pow(F.lit(10.0), (25.0 - F.col("mag")) / 2.5)
    grid = spark.range(size * size).select(F.lit(0).cast("long").alias("image_id"), (F.col("id") % size).cast("int").alias("x"), F.floor(F.col("id") / size).cast("int").alias("y"), F.lit(5.0).alias("value"))
    lit = simulate.inject(grid, stars.select(F.lit(0).cast("long").alias("image_id"), F.col("px").alias("x0"), F.col("py").alias("y0"), flux.alias("flux")), 1.2)
    pixels = [float(v["value"]) for v in lit.orderBy("y", "x").collect()]
    frame = frame.withColumn("pixels", F.array(*map(F.lit, pixels)).cast("array<float>"))
    targets = stars.where("star_id < 3").select(F.col("star_id").alias("target_id"), "ra", "dec")
    got = transients.forced_photometry(targets, stars.where("star_id >= 3").select("star_id", "ra", "dec", "mag"), frame, 6).collect()
    assert len(got) == 3 and all(g["calibrated"] and g["n_ref_stars"] >= 3 for g in got)
    assert {g["target_id"]: round(g["mag"], 1) for g in got} == {0: 15.0, 1: 15.2, 2: 15.4}


def test_difference_query_and_injection(spark):
    from tessella.plans import transients

    f = frames(spark, lambda i, k: 10.0 + k % 3, n=3, size=24, step=0.02).withColumn("date_obs", F.lit("2024-01-01").cast("timestamp"))
    centre = f.where("image_id = 1").select(F.lit(5).cast("long").alias("target_id"), F.col("crval1").alias("ra"), F.col("crval2").alias("dec"))
    away = spark.createDataFrame([(6, 200.0, 89.0)], "target_id long, ra double, dec double")
    bright = f.withColumn("pixels", F.transform("pixels", lambda v, i: v + F.when(i == 11 * 24 + 12, 500.0).otherwise(0.0)).cast("array<float>"))
    got = {r["target_id"]: r for r in transients.difference_query(centre.unionByName(away), bright, f, 5, "date_obs").collect()}
    assert got[5]["reason"] == "found" and got[5]["recovered"] and (got[5]["peak_x"], got[5]["peak_y"]) == (12, 11)
    assert got[6]["reason"] == "no_index_hit" and got[6]["peak"] is None
    tiles = spark.range(60 * 81).select((F.col("id") % 60).alias("image_id"), (F.floor(F.col("id") / 60) % 9).cast("int").alias("x"), F.floor(F.col("id") / 540).cast("int").alias("y"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 100).alias("value"))
    table = transients.injection_recovery(tiles, (1, 200), {"A": 0.3, "B": 1.0}).collect()
    share = {(r["level"], r["station"]): r["share"] for r in table}
    assert share[200, "A"] > 0.95 and share[200, "any"] >= share[200, "B"] and share[1, "B"] < 0.5


def test_tile_arrays_equal_tile_rows(spark):
    from tessella.operators import tilearrays

    f = frames(spark, lambda i, k: float("nan") if (i + k) % 11 == 0 else i * 10 + k % 13)
    rows = {(r["npix"], r["y"] * 8 + r["x"]): r["value"] for r in build.build(f, build.Options(order=2))[2].collect()}
    arrays = tilearrays.coadd(tilearrays.sample_frames(f, 2, 8)).collect()
    got = {(r["npix"], k): v for r in arrays for k, v in enumerate(r["pixels"]) if v == v}
    assert set(got) == set(rows) and all(abs(got[k] - rows[k]) < 1e-6 for k in rows)


@pytest.mark.parametrize("overlay", images.OVERLAYS)
def test_build_honours_overlays_in_narrow_and_wide_tiles(spark, monkeypatch, overlay):
    """Rows and arrays agree, both with plain arithmetic over the samples, for image ids that are no numbers."""
    f = frames(spark, lambda i, k: float("nan") if k % 11 == 3 else i * 10 + k % 7).withColumns({"crval1": F.lit(40.0) + F.col("image_id") * 2, "crval2": F.lit(10.0)}).withColumn("image_id", F.concat(F.lit("f"), F.lpad("image_id", 3, "0")))
    options = build.Options(order=2, overlay=overlay, low=3.0, high=100.0)
    held = {}
    for r in build.sample_tiles(f, options).collect():
        held.setdefault((r["npix"], r["x"], r["y"]), []).append((r["source"], r["value"], r["weight"]))
    want = {}
    for at, rows in held.items():
        values, weights = [v for _, v, _ in rows], [w for _, _, w in rows]
        want[at] = {
            "mean": lambda: sum(values) / len(values), "add": lambda: sum(values), "first": lambda: min(rows)[1],
            "weighted": lambda: sum(v * w for v, w in zip(values, weights, strict=True)) / sum(weights), "fading": lambda: sum(v * w for v, w in zip(values, weights, strict=True)) / sum(weights),
        }[overlay]()
    assert any(len(rows) > 1 for rows in held.values())
    for narrow in (16, 4):
        monkeypatch.setattr(build, "NARROW", narrow)
        got = {(r["npix"], r["x"], r["y"]): r["value"] for r in build.build(f, options)[2].collect()}
        assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_unknown_overlays_are_refused(spark):
    with pytest.raises(ValueError):
        build.build(frames(spark, lambda i, k: 1.0), build.Options(order=2, overlay="median"))


def test_squares_are_clipped_to_the_frame(spark):
    from tessella.plans import transients

    f = frames(spark, lambda i, k: float("nan") if k == 13 else k, n=1)
    at = spark.createDataFrame([(0, 1, 0.4, 1.2), (0, 2, 11.6, 5.0), (0, 3, -9.0, 4.0)], "image_id long, star_id long, x double, y double")
    got = {(r["star_id"], r["x"], r["y"]): r["value"] for r in transients.around(at, f, 2).collect()}
    want = {(s, x, y): None if (x, y) == (1, 1) else float(12 * y + x) for s, x0, y0 in ((1, 0, 1), (2, 12, 5)) for x in range(x0 - 2, x0 + 3) for y in range(y0 - 2, y0 + 3) if 0 <= x < 12 and 0 <= y < 12}
    assert got == want


def test_groups_of_frames_are_built_in_one_job(spark):
    f = frames(spark, lambda i, k: i + k % 5).withColumn("station", (F.col("image_id") % 2).cast("string"))
    o = build.Options(order=2)
    seen = f.select("image_id", "station").unionByName(f.select("image_id", F.lit("all").alias("station")))
    every = build.epoch_builds(seen, f, ("station",), o)
    for name, part in (("0", f.where("station = '0'")), ("all", f)):
        one = build.build(part, o)[2].withColumnRenamed("value", "v")
        both = every.where(F.col("station") == name).join(one, ["npix", "x", "y"], "full")
        assert both.where("value is null or v is null or abs(value - v) > 1e-9").count() == 0
    assert {r["station"] for r in build.tile_counts(every, ("station",)).collect()} == {"0", "1", "all"}


def test_nearest_pixel_equals_all_pairs(spark):
    r = random.Random(4)
    a, b = ([(g, i, r.uniform(-60, 60), r.uniform(-60, 60)) for g in (1, 2) for i in range(60)] for _ in (0, 1))
    schema = "g int, id long, x double, y double"
    got = {(x["g"], x["left_id"]): x["right_id"] for x in measure.nearest_pixel(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ("g",), 8.0).collect()}
    want = {}
    for g, i, x, y in a:
        near = min((((x - u) ** 2 + (y - v) ** 2) ** 0.5, j) for h, j, u, v in b if h == g)
        if near[0] <= 8:
            want[g, i] = near[1]
    assert got == want


def test_background_like_pixels_keep_off_sources_and_edges(spark):
    rows = [(1, x, y, 10.0 + (x * 7 + y * 3) % 5 * 0.1 + (50.0 if (x, y) == (4, 4) else 0)) for x in range(9) for y in range(9)]
    got = measure.background_like(spark.createDataFrame(rows, "g int, x int, y int, value double"), ("g",), 9, 9, 1.8, 2)
    places = {(r["x"], r["y"]) for r in got.collect()}
    assert places and (4, 4) not in places and all(2 <= v <= 6 for p in places for v in p)


def test_source_keys_resolve_in_four_steps(spark):
    from tessella.operators.coverage import resolve_sources

    files = spark.createDataFrame([(p,) for p in ("/data/a/1.fits", "/data/deep/b/2.fits", "/data/deep/c/2.fits", "/far/3.fits", "/", "", None)], "path string")
    keys = spark.createDataFrame([(k,) for k in ("/far/3.fits", "a/1.fits", "c/2.fits", "x/2.fits", "x/9.fits", "/1.fits", None)], "source_key string")
    got = {r["source_key"]: (r["path"], r["how"]) for r in resolve_sources(keys, files, "/data").collect()}
    assert got["/far/3.fits"] == ("/far/3.fits", "exact") and got["a/1.fits"] == ("/data/a/1.fits", "exact")
    assert got["c/2.fits"] == ("/data/deep/c/2.fits", "suffix") and got["x/2.fits"] == ("/data/deep/b/2.fits", "basename")
    assert got["x/9.fits"] == (None, None) and got[None] == (None, None) and got["/1.fits"][0] == "/data/a/1.fits"


def test_apertures_of_positions_equal_those_of_pixel_rows(spark):
    """Edges, blanks and a frame without positions; no pixel becomes a row."""
    from tessella.operators import measure
    from tessella.plans import transients

    f = frames(spark, lambda i, k: float("nan") if (i + k) % 7 == 0 else i * 10 + k % 13, n=4, size=20, step=0.02)
    r = random.Random(3)
    spots = [(i, s, r.uniform(0, 19.99), r.uniform(0, 19.99)) for i in (0, 1, 3, 9) for s in range(40)] + [(1, 99, 0.0, 0.0), (1, 100, 19.5, 19.5)]
    p = spark.createDataFrame(spots, "image_id long, star_id long, x double, y double")
    got = measure.apertures_at(p, f, 1.5, 2.0, 4.0)
    want = measure.aperture(transients.around(p, f, 5), ("image_id", "star_id"), F.col("x0"), F.col("y0"), 1.5, 2.0, 4.0)
    key = lambda rows: {(v["image_id"], v["star_id"]): [v[c] for c in ("n_pixels", "sky", "flux", "flux_err", "snr")] for v in rows.collect()}
    got, want = key(got), key(want)
    assert set(got) == set(want) and len(got) == 122 and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    stars = spark.createDataFrame([(1, 40.0, 10.0, 15.0)], "star_id long, ra double, dec double, mag double")
    out = transients.forced_photometry(stars.select(F.col("star_id").alias("target_id"), "ra", "dec"), stars, f.withColumn("date_obs", F.current_timestamp()), 5)
    assert "posexplode" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_peaks_of_arrays_equal_those_of_pixel_rows(spark):
    """Even and odd counts, one pixel, no scatter; a false-positive run shuffles places, not draws."""
    from tessella.operators import measure
    from tessella.plans import transients

    r = random.Random(2)
    images = {0: [r.gauss(0, 1) for _ in range(64)], 1: [r.gauss(0, 1) for _ in range(9)], 2: [4.0], 3: [1.0, 1.0, 1.0, 7.0], 4: [2.0] * 5}
    rows = spark.createDataFrame([(k, i, 0, v) for k, d in images.items() for i, v in enumerate(d)], "k int, x int, y int, d double")
    want = {v["k"]: v["peak_snr"] for v in measure.difference_statistics(rows, ("k",)).collect()}
    arrays = spark.createDataFrame([*images.items(), (5, [])], "k int, d array<double>")
    got = {v["k"]: v["peak_snr"] for v in measure.with_peak_snr(arrays, "d").collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    tiles = rows.select(F.col("k").alias("image_id"), "x", "y", F.col("d").alias("value"))
    plan = transients.false_positive_run(tiles, {"A": 1.0}, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 2
