"""The FITS data source and compressed images: what is fetched, and that parts and packed files equal plain ones."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException

from tessella.sources import compressed, fits, fitssource
from tests import fz

WCS = {"CRVAL1": 15.0, "CRVAL2": -2.0, "CRPIX1": 5.0, "CRPIX2": 5.0, "CD1_1": -1e-4, "CD2_2": 1e-4}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Six frames of 400 x 300 pixels, one of them broken and one in a folder of results."""
    path = tmp_path_factory.mktemp("frames")
    (path / "out").mkdir()
    for k in range(5):
        (path / f"f{k}.fits").write_bytes(fits.encode(np.arange(120_000) + k, 400, 300, {**WCS, "EXPTIME": float(k)}))
    (path / "out/g.fits").write_bytes(fits.encode(np.arange(120_000), 400, 300, WCS))
    (path / "bad.fits").write_bytes(b"no image".ljust(5000))
    (path / "cut.fit").write_bytes(fits.encode(np.arange(120_000), 400, 300, WCS)[:9000])
    (path / "notes.txt").write_text("x")
    return str(path)


def test_headers_are_read_without_pixels(spark, folder):
    rows = fitssource.open_ranged(spark, folder, ("path", "width", "height", "exptime", "cd1_1", "is_valid", "error", "bytes_fetched"), pattern="f*.fits").collect()
    assert sorted((r["exptime"], r["width"], r["height"], r["cd1_1"], r["is_valid"]) for r in rows) == [(float(k), 400, 300, -1e-4, True) for k in range(5)]
    assert all(r["bytes_fetched"] <= 4 * 2880 for r in rows)  # of 484,000


def test_a_part_fetches_its_lines(spark, folder):
    rows = fitssource.open_ranged(spark, folder, bounds=(10, 200, 30, 4), pattern="f*.fits").orderBy("path").collect()
    for k, r in enumerate(rows):
        assert (r["width"], r["height"], r["x0"], r["y0"], r["crpix1"], r["crpix2"]) == (30, 4, 10, 200, -5.0, -195.0)
        assert r["pixels"] == [float(y * 400 + x + k) for y in range(200, 204) for x in range(10, 40)]
        assert r["bytes_fetched"] <= 4 * 2880 + 4 * 1600
    whole = fitssource.open_ranged(spark, folder, pattern="f3.fits").first()
    assert whole["pixels"] == [float(v + 3) for v in range(120_000)] and whole["bytes_fetched"] >= 480_000


def test_ranged_rows_equal_whole_files(spark, folder):
    names = [c for c in fits.read(spark, folder).columns if c != "path"]
    order = lambda df: sorted(df.selectExpr("substring_index(path, '/', -1) AS name", *names).collect(), key=lambda r: r["name"])
    for bounds in (None, (1, 2, 50, 60), (390, 290, 50, 60), (-5, -5, 10, 10)):
        assert order(fitssource.open_ranged(spark, folder, bounds=bounds)) == order(fits.read(spark, folder, bounds=bounds))
    assert {r["error"] for r in fitssource.open_ranged(spark, folder, ("path", "error"), bounds=(900, 0, 5, 5), pattern="f*").collect()} == {"the part lies outside the image"}


def test_options_choose_files_and_tasks(spark, folder, monkeypatch):
    names = lambda **o: sorted(r["path"].rsplit("/", 1)[1] for r in fitssource.open_ranged(spark, folder, ("path",), **o).collect())
    assert names() == ["bad.fits", "cut.fit", *(f"f{k}.fits" for k in range(5)), "g.fits"]
    assert names(limit=3) == ["bad.fits", "cut.fit", "f0.fits"]
    assert "g.fits" not in names(exclude=f"{folder}/out") and "g.fits" not in names(recursive="false")
    assert sorted(r["path"].rsplit("/", 1)[1] for r in fits.read(spark, folder, header_only=True, exclude=f"{folder}/out", pattern="[fg]*.fits").collect()) == [f"f{k}.fits" for k in range(5)]
    with pytest.raises(PySparkException):
        fitssource.open_ranged(spark, folder, mode="FAILFAST").collect()
    with pytest.raises(PySparkException):
        fitssource.open_ranged(spark, folder + "/nothing").collect()
    reader = fitssource.FitsReader(spark.createDataFrame([], fits.SCHEMA).schema, {"path": folder})
    monkeypatch.setattr(fitssource, "BYTES_PER_TASK", 1_000_000)
    assert [len(p.files) for p in reader.partitions()] == [4, 1, 2, 1] or sum(len(p.files) for p in reader.partitions()) == 8
    assert len(reader.partitions()) > 2


def test_filters_on_paths_open_no_other_files(spark, folder):
    one = fitssource.open_ranged(spark, folder, ("path", "exptime")).where(f"path = '{folder}/f2.fits'")
    assert [r["exptime"] for r in one.collect()] == [2.0]
    reader = fitssource.FitsReader(one.schema, {"path": folder})
    left = list(reader.pushFilters([fitssource.StringEndsWith(("path",), "3.fits"), fitssource.EqualTo(("exptime",), 3.0)]))
    assert len(left) == 1 and [f for p in reader.partitions() for f, _ in p.files] == [f"{folder}/f3.fits"]


def image(kind, h=37, w=61, seed=2):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    base = 900 + 5 * x + 3 * y + r.normal(0, 12, (h, w))
    base[5:9, 7:12] += 20_000
    return np.rint(base).astype(int) if kind == "int" else base


@pytest.mark.parametrize("method", ["RICE_1", "GZIP_1", "GZIP_2"])
@pytest.mark.parametrize(("bitpix", "tile"), [(16, None), (32, (16, 10)), (8, (61, 37))])
def test_packed_integers_equal_the_plain_file(method, bitpix, tile):
    pixels = np.minimum(image("int"), 250) if bitpix == 8 else image("int") - 15_000
    pixels[0, :3] = (-7 if bitpix > 8 else 7)
    cards = {**WCS, "BSCALE": 2.0, "BZERO": 10.0}
    null = -7 if bitpix > 8 else 7
    plain = fits.decode(fits.encode(pixels, 61, 37, {**cards, "BLANK": null}, bitpix, null))
    got = fits.decode(fz.pack(pixels, bitpix, method, tile, blank=null, cards=cards.items()), "a.fits.fz")
    assert got["hdu"] == 2 and math.isnan(got["pixels"][0])
    np.testing.assert_array_equal(got["pixels"], plain["pixels"])
    assert {k: got[k] for k in ("width", "height", "bitpix", "crpix1", "cd1_1", "is_valid")} == {k: plain[k] for k in ("width", "height", "bitpix", "crpix1", "cd1_1", "is_valid")}
    part = fits.decode(fz.pack(pixels, bitpix, method, tile, blank=null, cards=cards.items()), bounds=(20, 11, 9, 15))
    np.testing.assert_array_equal(part["pixels"], plain["pixels"].reshape(37, 61)[11:26, 20:29].ravel())


@pytest.mark.parametrize("quantize", ["NO_DITHER", "SUBTRACTIVE_DITHER_1", "SUBTRACTIVE_DITHER_2"])
@pytest.mark.parametrize("method", ["RICE_1", "GZIP_2"])
def test_quantised_floats_come_back_within_half_a_step(method, quantize):
    pixels = image("float")
    pixels[3, 4:8], pixels[10, ::5] = np.nan, 0.0
    got = fits.decode(fz.pack(pixels, -32, method, (61, 5), 0.5, quantize, seed=9990, loose=(2,)))["pixels"].reshape(37, 61)
    np.testing.assert_array_equal(np.isnan(got), np.isnan(pixels))
    assert np.nanmax(np.abs(got - pixels)) <= 0.2501
    np.testing.assert_array_equal(got[10:15], pixels.astype(np.float32)[10:15])  # a tile that was not quantised
    if quantize == "SUBTRACTIVE_DITHER_2":
        assert (got[10, ::5] == 0).all()


def test_a_long_tile_runs_through_the_dither_table():
    pixels = np.random.default_rng(3).normal(50, 9, (130, 200))
    got = fits.decode(fz.pack(pixels, -32, "RICE_1", (200, 130), 0.1, "SUBTRACTIVE_DITHER_1", seed=77))["pixels"]
    assert np.abs(got - pixels.ravel()).max() <= 0.0501


def test_unquantised_floats_and_refused_methods():
    pixels = image("float")
    for bitpix in (-32, -64):
        got = fits.decode(fz.pack(pixels, bitpix, "GZIP_1"))["pixels"]
        np.testing.assert_array_equal(got, pixels.astype(np.float32).ravel())
    with pytest.raises(ValueError, match="HCOMPRESS_1"):
        fits.decode(fz.pack(image("int"), 32, "HCOMPRESS_1"))
    with pytest.raises(ValueError):
        fits.decode(fz.pack(image("int"), 32)[:9000])


def test_rice_of_wild_and_constant_values():
    r = np.random.default_rng(8)
    for size, high in ((1, 255), (2, 32_767), (4, 2_147_483_647)):
        streams, want = [], []
        for n in (1, 5, 32, 33, 100):
            for values in (np.full(n, high // 3), r.integers(0 if size == 1 else -high, high, n), np.cumsum(r.integers(-2, 3, n)) % 100):
                want.append([int(v) for v in values])
                streams.append(fz.rice_bytes(want[-1], size))
        got = compressed.rice(streams, np.array([len(v) for v in want]), size, 32)
        assert [list(map(int, g)) for g in got] == want


def test_packed_files_through_the_source(spark, tmp_path):
    pixels = image("int", 200, 300)
    (tmp_path / "a.fits").write_bytes(fits.encode(pixels, 300, 200, WCS, 32))
    (tmp_path / "b.fits.fz").write_bytes(fz.pack(pixels, 32, "RICE_1", cards=WCS.items()))
    whole = {r["path"][-1]: r for r in fitssource.open_ranged(spark, str(tmp_path)).collect()}
    assert whole["z"]["pixels"] == whole["s"]["pixels"] and whole["z"]["hdu"] == 2 and whole["z"]["cd1_1"] == -1e-4
    part = {r["path"][-1]: r for r in fitssource.open_ranged(spark, str(tmp_path), bounds=(10, 100, 40, 6)).collect()}
    assert part["z"]["pixels"] == part["s"]["pixels"]
    assert part["z"]["bytes_fetched"] < 8 * 2880 < whole["z"]["bytes_fetched"]
    assert [r["pixels"] for r in fits.read(spark, str(tmp_path), pattern="*.fz").collect()] == [whole["s"]["pixels"]]
    head = fitssource.open_ranged(spark, str(tmp_path), ("path", "width", "bytes_fetched"), pattern="*.fz").first()
    assert head["width"] == 300 and head["bytes_fetched"] <= 2 * 4 * 2880
