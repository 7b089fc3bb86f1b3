"""Cut-outs in the build: the parts that tiles need give what whole frames give, from tables and from files."""

import numpy as np
import pytest

from tessella.operators import cutouts, polygons, tilearrays
from tessella.plans import build
from tessella.sources import fits, fitssource
from tests import fz

COLUMNS = ("image_id", *polygons.WCS)


def turned_frames(n, seed, scale=0.02):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        w, h, turn = int(r.integers(20, 90)), int(r.integers(20, 90)), r.uniform(0, 2 * np.pi)
        c, s = scale * np.cos(turn), scale * np.sin(turn)
        pixels = r.normal(100, 20, w * h)
        pixels[r.integers(0, w * h, 5)] = np.nan
        rows.append((i, w, h, float(r.uniform(0, 360)), float(r.uniform(-85, 85)), w / 2, h / 2, float(-c), float(s), float(s), float(c), [float(p) for p in pixels]))
    return rows


def frames_of(spark, rows):
    return spark.createDataFrame(rows, "image_id long, width int, height int, crval1 double, crval2 double, crpix1 double, crpix2 double, cd1_1 double, cd1_2 double, cd2_1 double, cd2_2 double, pixels array<double>")


@pytest.mark.parametrize("order", [2, 5, 7])
def test_parts_give_the_samples_of_whole_frames(spark, order):
    rows = turned_frames(25, order)
    whole = {r[0]: dict(zip(COLUMNS, r)) | {"pixels": r[-1]} for r in rows}
    cuts = polygons.cut_tiles(frames_of(spark, rows), order).collect()
    assert {(r["image_id"], r["npix"]) for r in cuts} == {(r["image_id"], r["npix"]) for r in polygons.footprint_cells(frames_of(spark, rows), order, ("image_id",)).collect()}
    smaller = 0
    for r in cuts:
        frame = whole[r["image_id"]]
        part = frame | {c: r[c] for c in polygons.CUT} | {"pixels": r["pixels"]}
        for policy in ("replace", "propagate"):
            for a, b in zip(tilearrays.sample(r["npix"], frame, order, 8, policy), tilearrays.sample(r["npix"], part, order, 8, policy), strict=True):
                np.testing.assert_array_equal(a, b)
        smaller += len(r["pixels"]) < len(frame["pixels"])
    assert smaller > len(cuts) / 3 or order < 7
    boxes = {(r["image_id"], r["npix"]): tuple(r[c] for c in polygons.CUT) for r in polygons.footprint_boxes(frames_of(spark, rows), order).collect()}
    assert boxes == {(r["image_id"], r["npix"]): tuple(r[c] for c in polygons.CUT) for r in cuts}


def test_rows_and_arrays_build_alike_from_parts(spark):
    frames = frames_of(spark, turned_frames(20, 4))
    options = build.Options(order=6, tile_width=16)
    keyed = lambda df: {(r["npix"], int(r["x"]), r["y"]): r["value"] for r in df.collect()}
    rows, arrays = keyed(build.narrow_tiles(frames, options)), keyed(build.wide_tiles(frames, options))
    assert rows.keys() == arrays.keys() and len(rows) > 500
    assert all(abs(rows[k] - arrays[k]) < 1e-9 for k in rows)


def test_pixels_that_do_not_fill_the_frame_fail(spark):
    row = turned_frames(1, 1)[0]
    with pytest.raises(Exception, match="reshape"):
        polygons.cut_tiles(frames_of(spark, [(*row[:-1], row[-1][:-3])]), 3).collect()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("sky")
    for row in turned_frames(8, 9, 0.01):
        i, w, h = row[:3]
        big = np.kron(np.nan_to_num(np.array(row[-1]).reshape(h, w), nan=3.0), np.ones((3, 3)))  # larger frames with the same field
        cards = dict(zip(("CRVAL1", "CRVAL2", "CRPIX1", "CRPIX2", "CD1_1", "CD1_2", "CD2_1", "CD2_2"), (row[3], row[4], 1.5 * w, 1.5 * h, *[c / 3 for c in row[7:11]]), strict=True))
        if i % 4 == 3:
            (path / f"f{i}.fits.fz").write_bytes(fz.pack(np.rint(big).astype(int), 32, "GZIP_1", (64, 16), cards=cards.items()))
        else:
            (path / f"f{i}.fits").write_bytes(fits.encode(np.rint(big), 3 * w, 3 * h, cards))
    (path / "broken.fits").write_bytes(b"x" * 9000)
    return str(path)


def test_a_build_from_files_equals_one_from_a_table(spark, folder):
    options = build.Options(order=7, tile_width=16, tree=True)
    frames = fitssource.open_ranged(spark, folder).where("is_valid").withColumnRenamed("path", "image_id")
    keyed = lambda df: {(r["npix"], int(r["x"]), r["y"]): round(r["value"], 6) for r in df.collect()}
    want, got = build.build(frames, options), build.build_files(spark, folder, options)
    assert keyed(want[7]) == keyed(got[7]) and keyed(want[6]) == keyed(got[6]) and len(keyed(got[7])) > 500


def test_dirty_tiles_fetch_their_parts_only(spark, folder):
    options = build.Options(order=7, tile_width=16)
    boxes = cutouts.file_boxes(spark, folder, 7)
    dirty = boxes.where("image_id LIKE '%f1.fits' OR image_id LIKE '%f3.fits.fz'").groupBy("npix").count().orderBy("npix").limit(2).select("npix")
    chosen = {r["npix"] for r in dirty.collect()}
    dirty = spark.createDataFrame([(p,) for p in chosen], "npix long")
    whole, some = cutouts.cut_files(spark, folder, 7), cutouts.cut_files(spark, folder, 7, dirty)
    assert {r["npix"] for r in some.collect()} == chosen
    fetched = lambda df: df.agg({"fetched": "sum"}).first()[0]
    assert fetched(some) < fetched(whole) / 4
    keyed = lambda df: {(r["npix"], int(r["x"]), r["y"]): round(r["value"], 6) for r in df.collect()}
    part, all_tiles = keyed(build.build_files(spark, folder, options, dirty)[7]), keyed(build.build_files(spark, folder, options)[7])
    assert part == {k: v for k, v in all_tiles.items() if k[0] in chosen}
    # The plan decides between a full read and parts; both give the same pixels.
    key = lambda df: sorted(df.selectExpr("image_id", "npix", "xxhash64(pixels) AS h").collect())
    assert key(cutouts.cut_files(spark, folder, 7, full_read=0.0)) == key(cutouts.cut_files(spark, folder, 7, full_read=2.0))
