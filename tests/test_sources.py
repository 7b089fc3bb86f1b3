"""FITS files, the index and cut-out plans."""

import os

import numpy as np
import pytest

from tessella.operators import cutouts
from tessella.sources import fits, index


def image(tmp_path, name, pixels, width, height, cards=None, **kw):
    (tmp_path / name).write_bytes(fits.encode(pixels, width, height, cards, **kw))


WCS = {"CRVAL1": 15.0, "CRVAL2": -2.0, "CRPIX1": 5.0, "CRPIX2": 5.0, "CD1_1": -1e-4, "CD1_2": 0.0, "CD2_1": 0.0, "CD2_2": 1e-4, "CTYPE1": "RA---TAN", "FILTER": "o'r"}


def test_cutout(spark, tmp_path):
    image(tmp_path, "a.fits", range(24), 6, 4, WCS)
    r = fits.read(spark, str(tmp_path), bounds=(2, 1, 3, 2)).first()
    assert (r["width"], r["height"], r["crpix1"], r["crpix2"]) == (3, 2, 3.0, 4.0)
    assert len(r["pixels"]) == 6 and r["pixels"][0] == 8 and r["pixels"][-1] == 16 and r["filter"] == "o'r" and r["is_valid"]


@pytest.mark.parametrize("bitpix", [8, 16, 32, 64, -32, -64])
def test_all_pixel_types_round_trip(spark, tmp_path, bitpix):
    values = [0, 1, 2, 100, 7, 9]
    image(tmp_path, "a.FIT", values, 3, 2, {"BSCALE": 2.0, "BZERO": 10.0}, bitpix=bitpix)
    assert fits.read(spark, str(tmp_path)).first()["pixels"] == [v * 2 + 10 for v in values]


def test_blank_and_nan(spark, tmp_path):
    image(tmp_path, "a.fits", [1, float("nan"), 3, 4], 2, 2, bitpix=16, blank=-99)
    got = fits.read(spark, str(tmp_path)).first()["pixels"]
    assert np.isnan(got[1]) and got[0] == 1
    with pytest.raises(ValueError):
        fits.encode([float("nan")], 1, 1, bitpix=16)


def test_first_image_unit_is_chosen(spark, tmp_path):
    primary = "".join(c.ljust(80) for c in ("SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0", "END")).encode().ljust(2880)
    part = fits.encode(range(48), 8, 6).replace(b"SIMPLE  =                    T", b"XTENSION= 'IMAGE   '          ", 1)
    (tmp_path / "a.fits").write_bytes(primary + part)
    r = fits.read(spark, str(tmp_path), header_only=True).first()
    assert (r["hdu"], r["width"], r["height"], r["pixels"]) == (2, 8, 6, None)


def test_broken_files(spark, tmp_path):
    (tmp_path / "bad.fits").write_bytes(b"nothing")
    (tmp_path / "cut.fits").write_bytes(fits.encode(range(4000), 100, 40)[:4000])
    image(tmp_path, "good.fits", range(4), 2, 2, WCS)
    (tmp_path / "note.txt").write_text("x")
    rows = {os.path.basename(r["path"]): r["error"] for r in fits.read(spark, str(tmp_path)).collect()}
    assert rows["good.fits"] is None and rows["bad.fits"] and rows["cut.fits"] and len(rows) == 3
    with pytest.raises(Exception, match="FITS|END|empty|cut off"):
        fits.read(spark, str(tmp_path), mode="FAILFAST").collect()


def test_pattern_limit_and_exclusion(spark, tmp_path):
    for k in range(5):
        image(tmp_path, f"f{k}.fits", range(4), 2, 2, WCS)
    (tmp_path / "out").mkdir()
    image(tmp_path / "out", "f9.fits", range(4), 2, 2)
    names = lambda df: sorted(os.path.basename(r["path"]) for r in df.collect())
    assert names(fits.read(spark, str(tmp_path), limit=2)) == ["f0.fits", "f1.fits"]
    assert names(fits.list_files(spark, str(tmp_path), exclude=f"file:{tmp_path}/out")) == [f"f{k}.fits" for k in range(5)]
    assert names(fits.read(spark, str(tmp_path), pattern="*4.fits")) == ["f4.fits"]


def test_cdelt_fallback():
    row = fits.decode(fits.encode(range(4), 2, 2, {"CDELT1": -0.1, "CDELT2": 0.1, "CROTA2": 90.0}))
    assert row["is_valid"] and abs(row["cd1_2"] + 0.1) < 1e-12 and abs(row["cd1_1"]) < 1e-12


def test_export_and_reread(spark, tmp_path):
    tiles = spark.createDataFrame([(12345, [float(k) for k in range(16)]), (7, [None] * 16)], "npix long, pixels array<double>")
    fits.export(fits.with_content(tiles, 5, 4), str(tmp_path))
    got = {r["path"].rsplit("/", 3)[1:][-1]: r["pixels"] for r in fits.read(spark, str(tmp_path)).collect()}
    assert got["Npix12345.fits"] == [float(k) for k in range(16)] and all(np.isnan(got["Npix7.fits"]))
    assert (tmp_path / "Norder5/Dir10000/Npix12345.fits").exists()


def test_index_files(spark, tmp_path):
    rows = spark.createDataFrame([(3, 5, "a/b.fits", 10), (3, 20001, "c.fits", 20)], "order int, npix long, filepath string, cellmem long")
    index.write_index(rows, str(tmp_path / "i"))
    with open(tmp_path / "i" / "order=3" / "dir=0" / "bad.json", "w") as f:
        f.write("{not json\n")
    got = sorted(tuple(r) for r in index.read_index(spark, str(tmp_path / "i")).collect())
    assert got == [(3, 5, "a/b.fits", 10, "b.fits"), (3, 20001, "c.fits", 20, "c.fits")]


def test_tiles_replace_their_partitions_only(spark, tmp_path):
    rows = spark.createDataFrame([(3, 5, 1.0), (3, 20001, 2.0)], "order int, npix long, value double")
    index.write_tiles(rows, str(tmp_path / "t"))
    index.write_tiles(spark.createDataFrame([(3, 6, 9.0)], "order int, npix long, value double"), str(tmp_path / "t"))
    assert sorted(r["npix"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [6, 20001]


def boxes(spark, rows):
    return spark.createDataFrame(rows, "image_id long, x0 int, y0 int, w int, h int, width int, height int")


def test_cells_snap(spark):
    b = boxes(spark, [(1, 10, 10, 20, 20, 128, 128), (1, 18, 18, 20, 10, 128, 128), (1, 80, 16, 8, 8, 128, 128)])
    assert sorted((r["x0"], r["y0"]) for r in cutouts.cells(b, 32).collect()) == [(0, 0), (32, 0), (64, 0)]
    p = cutouts.plan(b, 32).first()
    assert p["planned"] == 3 * 32 * 32 and not p["read_full"]
    full = cutouts.plan(boxes(spark, [(1, 0, 0, 128, 128, 128, 128)]), 32).first()
    assert full["read_full"] and full["share"] == 1.0


def test_jobs(spark):
    b = boxes(spark, [(1, 10, 10, 5, 5, 128, 128), (1, 40, 10, 5, 5, 128, 128), (2, 0, 0, 256, 128, 256, 128), (3, 70, 0, 5, 5, 64, 64)])
    j = cutouts.jobs(b, 32).collect()
    assert len(j) == 3 and sum(r["read_full"] for r in j) == 1


def test_tile_files_are_found_by_path(spark, tmp_path):
    from tessella.sources import index as ix

    for name in ("Norder3/Dir0/Npix7.fits", "Norder4/Dir10000/Npix10012.fits", "Norder4/Dir0/Npix3.fits", "properties", "Norder3/Allsky.fits"):
        (tmp_path / "hips" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "hips" / name).write_bytes(b"x")
    found = ix.list_tiles(spark, str(tmp_path / "hips"))
    assert {(r["order"], r["npix"]) for r in found.collect()} == {(3, 7), (4, 10012), (4, 3)}
    assert {r["npix"] for r in ix.highest_tiles(found.select("path")).collect()} == {10012, 3}
    assert ix.highest_tiles(found.select("path").where("false")).count() == 0


def test_rows_are_written_as_json_and_csv(spark, tmp_path):
    import pytest

    from tessella.sources import index as ix

    a = spark.createDataFrame([(1, "x"), (2, None)], "id long, name string")
    both = ix.union_of([a, spark.createDataFrame([(3, 0.5)], "id long, snr double")])
    want = {(1, "x", None), (2, None, None), (3, None, 0.5)}
    for form, read in (("json", lambda p: spark.read.schema(both.schema).json(p)), ("csv", lambda p: spark.read.schema(both.schema).option("header", "true").csv(p))):
        ix.write_rows(both, str(tmp_path / form), form)
        assert {(r["id"], r["name"], r["snr"]) for r in read(str(tmp_path / form)).collect()} == want
    with pytest.raises(ValueError):
        ix.write_rows(both, str(tmp_path / "x"), "xml")
