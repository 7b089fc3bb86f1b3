"""Order statistics against a plain sort, over ties, wide ranges and blanks, with small limits so that rounds are needed."""

import math
import random

import pytest

from tessella.operators import images, orderstats


def column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double").repartition(4)


@pytest.mark.parametrize("kind", ["even", "ties", "wide", "two", "one"])
def test_ranks_equal_a_sort(spark, monkeypatch, kind):
    monkeypatch.setattr(orderstats, "FEW", 3)
    monkeypatch.setattr(orderstats, "ACCURACY", 40)
    r = random.Random(kind)
    values = {
        "even": [r.uniform(-5, 5) for _ in range(3000)], "ties": [float(r.choice([1, 1, 1, 1, 2, 3, 3, 9])) + (r.random() < 0.02) * r.random() for _ in range(3000)],
        "wide": [10 ** r.uniform(-200, 200) * r.choice([-1, 1]) for _ in range(2000)], "two": [0.0, 1.0] * 500, "one": [4.0] * 300,
    }[kind]
    n, ordered = len(values), sorted(values)
    ranks = [0, 1, n // 100, n // 2, n - n // 100 - 1, n - 1, r.randrange(n)]
    assert orderstats.at_ranks(column(spark, values), "v", ranks) == [ordered[k] for k in ranks]


def test_quantiles_blanks_and_empty_columns(spark):
    values = [5.0, 1.0, None, 3.0, float("nan"), 2.0, 4.0]
    assert orderstats.quantiles(column(spark, values), "v", [0.0, 0.2, 0.21, 1.0]) == [1.0, 1.0, 2.0, 5.0]
    assert orderstats.quantiles(column(spark, values), "v", [0.1, 0.5], interpolate=True) == pytest.approx([1.4, 3.0])
    assert all(map(math.isnan, orderstats.at_ranks(column(spark, [None, float("nan")]), "v", [0, 5])))
    assert tuple(images.valid_range(column(spark, [None]), "v").first()) == (0, None, None, None, None)
    assert tuple(images.valid_range(column(spark, values), "v", (0.5, 9.0)).first()) == (5, 0.5, 9.0, 1.0, 5.0)
    assert tuple(images.valid_range(column(spark, values), "v", (-1.0, 9.0)).first())[1:3] == (1.0, 5.0)
