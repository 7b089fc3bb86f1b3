"""Detection on smoothed images and catalogue shifts, against plain loops and planted shifts."""

import math
import random

import numpy as np
import pytest

from tessella.operators import detect


def frame(seed, w=90, h=70, stars=10):
    r = random.Random(seed)
    image = np.array([[100 + r.gauss(0, 2) for _ in range(w)] for _ in range(h)])
    places = []
    while len(places) < stars:
        x, y = r.randrange(8, w - 8), r.randrange(8, h - 8)
        if all(abs(x - a) > 8 or abs(y - b) > 8 for a, b in places):
            places.append((x, y))
            for i in range(-2, 3):
                for j in range(-2, 3):
                    image[y + j, x + i] += 300 * math.exp(-(i * i + j * j) / 2)
    return image, places


def test_smoothing_and_peaks_equal_plain_loops():
    image, _ = frame(1, 25, 18, 1)
    image[3, 4] = np.nan
    got = detect.smoothed(image, 1.2)
    filled = np.where(np.isnan(image), np.nanmedian(image), image)
    k = [math.exp(-(i * i) / (2 * 1.44)) for i in range(-5, 6)]
    for y, x in ((0, 0), (3, 4), (10, 12), (17, 24)):
        want = sum(k[i + 5] * k[j + 5] * filled[min(max(y + j, 0), 17), min(max(x + i, 0), 24)] for i in range(-5, 6) for j in range(-5, 6)) / sum(k) ** 2
        assert got[y, x] == pytest.approx(want)
    x, y, v = detect.peaks(image, 1.2, 3, 1.0, 250)
    limit = np.median(got) + got.std()
    want = {(b, a) for a in range(18) for b in range(25) if got[a, b] > limit and got[a, b] == got[max(a - 3, 0) : a + 4, max(b - 3, 0) : b + 4].max()}
    assert set(zip(x.tolist(), y.tolist(), strict=True)) == want and list(v) == sorted(v, reverse=True)
    assert len(detect.peaks(image, 1.2, 3, 1.0, 1)[0]) == 1


def test_planted_shifts_are_found(spark):
    rows, predicted = [], []
    shifts = {0: (13.25, -6.5), 1: (-9.75, 3.5), 2: (0.0, 0.0)}
    for k, (dx, dy) in shifts.items():
        image, places = frame(10 + k)
        rows.append((k, 90, 70, image.ravel().tolist()))
        predicted += [(k, i, x - dx, y - dy) for i, (x, y) in enumerate(places)]
    rows += [(3, 90, 70, [5.0] * 6300), (4, 90, 70, None), (5, 90, 70, [float("nan")] * 6300)]
    predicted += [(3, 0, 20.0, 20.0), (4, 0, 20.0, 20.0)]
    image, places = frame(20, stars=2)
    rows.append((6, 90, 70, image.ravel().tolist()))
    predicted += [(6, i, x - 9.0, y + 5.0) for i, (x, y) in enumerate(places)]
    frames = spark.createDataFrame(rows, "image_id int, width int, height int, pixels array<double>")
    found = {r["image_id"]: r for r in detect.catalogue_shift(frames, spark.createDataFrame(predicted, "image_id int, id long, x double, y double"), ("image_id",), border=0.0).collect()}
    assert len(found) == 7
    for k, shift in shifts.items():
        assert (found[k]["dx"], found[k]["dy"]) == pytest.approx(shift, abs=0.3) and found[k]["refined"] and found[k]["n_matched"] >= 8
    for k in (3, 4, 5):
        assert (found[k]["dx"], found[k]["dy"], found[k]["votes"], found[k]["refined"]) == (0.0, 0.0, 0, False)
    assert (found[6]["dx"], found[6]["dy"]) == (8.0, -4.0) and not found[6]["refined"]  # two matches leave the vote: 9 and -5 lie in the bins of 8 and -4


def test_shift_votes_are_those_of_all_pairs(spark, monkeypatch):
    """Cells cut into pieces, and bins too many for one array; no pair becomes a row before the winner is known."""
    from collections import Counter
    from statistics import median

    from tessella.operators import measure

    r = random.Random(8)
    p = [(f, r.uniform(-50, 300), r.uniform(0, 200)) for f in (1, 2) for _ in range(150)]
    q = [(f, x + 5.3 + r.uniform(-0.4, 0.4), y - 9.1) for f, x, y in p if r.random() < 0.6] + [(3, 1.0, 1.0)]
    d, e = spark.createDataFrame(q, "f int, x double, y double"), spark.createDataFrame(p, "f int, x double, y double")
    want = {}
    for f in (1, 2):
        offsets = [(a - x, b - y) for g, a, b in q if g == f for h, x, y in p if h == f and abs(a - x) < 40 and abs(b - y) < 40]
        (bx, by), votes = min(Counter((int(a // 4), int(b // 4)) for a, b in offsets).items(), key=lambda v: (-v[1], v[0]))
        near = [(a, b) for a, b in offsets if abs(a - (bx + 0.5) * 4) <= 4 and abs(b - (by + 0.5) * 4) <= 4]
        want[f] = (votes, median(a for a, _ in near), median(b for _, b in near), len(near))
    for piece, bins, offsets in ((4096, 1 << 22, 1 << 18), (7, 10, 128)):
        for name, value in (("PIECE", piece), ("BINS", bins), ("OFFSETS", offsets)):
            monkeypatch.setattr(measure, name, value)
        one, other = ([np.array(v) for v in zip(*[s[1:] for s in t if s[0] == 1], strict=True)] for t in (q, p))
        counted = {(int(x), int(y)): int(n) for x, y, n in zip(*measure._counted(*one, *other, 40.0, 4.0), strict=True)}  # tasks have constants of their own
        assert counted == Counter((int(a // 4), int(b // 4)) for x, y in zip(*one, strict=True) for px, py in zip(*other, strict=True) for a, b in [(x - px, y - py)] if abs(a) < 40 and abs(b) < 40)
        got = {x["f"]: (x["votes"], x["dx"], x["dy"], x["n_near"]) for x in measure.shift_vote(d, e, ("f",), 40.0).collect()}
        assert set(got) == {1, 2} and all(got[f] == pytest.approx(want[f], abs=1e-9) for f in want)


def test_the_last_of_equally_near_positions(spark):
    from tessella.operators import measure

    left = spark.createDataFrame([(1, 10, 0.0, 0.0), (1, 11, 9.0, 9.0)], "f int, id long, x double, y double")
    right = spark.createDataFrame([(1, 20, 3.0, 4.0), (1, 21, -4.0, 3.0), (1, 22, 0.0, 5.0), (1, 23, 0.0, 6.0), (2, 24, 0.0, 0.0)], "f int, id long, x double, y double")
    for last, want in ((False, 20), (True, 22)):
        got = {r["left_id"]: r["right_id"] for r in measure.nearest_pixel(left, right, ("f",), 5.5, last).collect()}
        assert got[10] == want
