"""The background surface against plain loops: partial cells at the rim, cells without values, images without good cells."""

import random
from statistics import median, pstdev

import pytest

from tessella.operators import measure

WIDTH, HEIGHT, CELL = 11, 7, 4


def clipped(values):
    kept = list(values)
    for _ in range(3):
        m, s = median(kept), pstdev(kept)
        kept = [v for v in kept if abs(v - m) <= 3 * s]
    return (median(kept), pstdev(kept)) if kept else None


def surface(image):
    across, up = -(-WIDTH // CELL), -(-HEIGHT // CELL)
    good = {}
    for i in range(across):
        for j in range(up):
            inside = [(x, y) for x in range(i * CELL, min(WIDTH, (i + 1) * CELL)) for y in range(j * CELL, min(HEIGHT, (j + 1) * CELL))]
            values = [image[p] for p in inside if image.get(p) is not None]
            if len(values) >= 0.5 * len(inside):
                good[i, j] = clipped(values)
    values = [v for v in image.values() if v is not None]
    if not good:
        return {p: (clipped(values) if values else None, True) for p in image}
    around = lambda cells, i, j, k: [v[k] for (a, b), v in cells.items() if abs(a - i) <= 1 and abs(b - j) <= 1]
    mesh = [(i, j) for i in range(across) for j in range(up)]
    filled = {c: good.get(c) or tuple(median(around(good, *c, k) or [v[k] for v in good.values()]) for k in (0, 1)) for c in mesh}
    smooth = {c: tuple(median(around(filled, *c, k)) for k in (0, 1)) for c in mesh}
    out = {}
    for x, y in image:
        gx, gy = min(max((x + 0.5) / CELL - 0.5, 0), across - 1), min(max((y + 0.5) / CELL - 0.5, 0), up - 1)
        out[x, y] = tuple(sum(v[k] * (1 - abs(i - gx)) * (1 - abs(j - gy)) for (i, j), v in smooth.items() if abs(i - gx) < 1 and abs(j - gy) < 1) for k in (0, 1)), False
    return out


def test_surface_equals_plain_loops(spark):
    r = random.Random(6)
    images = {}
    for k in range(5):
        images[k] = {(x, y): 100 + 3 * x - 2 * y + r.gauss(0, 4) + (400 if r.random() < 0.04 else 0) for x in range(WIDTH) for y in range(HEIGHT)}
    images[1] |= {(x, y): None for x in range(4, 8) for y in range(4)}  # a cell without values
    images[2] |= {(x, y): None for x in range(WIDTH) for y in range(HEIGHT) if (x, y) != (5, 5) and x + y > 4}  # one good cell at most
    images[3] |= {(x, y): None for x in range(WIDTH) for y in range(HEIGHT) if x % 2 or y % 2}  # no good cell
    images[4] = dict.fromkeys(images[4])  # no values
    rows = [(k, x, y, v) for k, image in images.items() for (x, y), v in image.items()]
    got = measure.background_surface(spark.createDataFrame(rows, "image_id int, x int, y int, value double"), ("image_id",), WIDTH, HEIGHT, CELL).collect()
    assert len(got) == len(rows)
    want = {k: surface(image) for k, image in images.items()}
    for g in got:
        numbers, flat = want[g["image_id"]][g["x"], g["y"]]
        assert g["flat"] == flat and g["value"] == images[g["image_id"]][g["x"], g["y"]]
        if numbers is None:
            assert g["background"] is None and g["rms"] is None
        else:
            assert (g["background"], g["rms"]) == pytest.approx(numbers)
    assert {g["image_id"] for g in got if g["flat"]} == {3, 4}


def test_large_groups_are_clipped_as_small_ones_are(spark, monkeypatch):
    """Repeated values, one value only, even and odd counts, and a sketch too coarse to be near the median."""
    r = random.Random(5)
    rows = [(g, v) for g, values in enumerate((
        [r.gauss(0, 1) for _ in range(4001)] + [50.0] * 30, [float(r.randrange(5)) for _ in range(3000)], [7.0] * 900, [1.0] * 500 + [2.0] * 500, [r.random() ** 9 for _ in range(2000)], [3.0, 4.0, 90.0],
    )) for v in values]
    values = spark.createDataFrame(rows, "g int, v double")
    want = {x["g"]: tuple(x)[1:] for x in measure.clip_sigma(values, ("g",), "v").collect()}
    monkeypatch.setattr(measure, "LARGE", 500)
    for accuracy in (10_000, 5):
        monkeypatch.setattr(measure, "ACCURACY", accuracy)
        out = measure.clip_sigma(values, ("g",), "v")
        got = {x["g"]: tuple(x)[1:] for x in out.collect()}
        assert set(got) == set(want) and all(got[g] == pytest.approx(want[g], abs=1e-9) for g in want)
