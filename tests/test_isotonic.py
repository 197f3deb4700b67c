"""Isotonic blocks against pooling of adjacent violators."""

import numpy as np
import pytest

from kiln.operators import isotonic


def pooled(rows):
    """(x_lo, x_hi, weight, value) by pooling, points of one x first."""
    points = {}
    for x, y, w in rows:
        if x is not None and y is not None and w is not None and w > 0:
            a, b = points.get(x, (0.0, 0.0))
            points[x] = (a + w, b + w * y)
    blocks = []
    for x in sorted(points):
        blocks.append([x, x, *points[x]])
        while len(blocks) > 1 and blocks[-2][3] / blocks[-2][2] >= blocks[-1][3] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    return [(lo, hi, w, s / w) for lo, hi, w, s in blocks]


def check(spark, rows, ranges):
    df = spark.createDataFrame(rows, "x double, y double, w double").repartition(3)
    got = sorted(tuple(r) for r in isotonic.isotonic_blocks(df, "x", "y", "w", ranges=ranges).collect())
    want = pooled(rows)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2:] for r in got], [r[2:] for r in want], rtol=1e-9)


@pytest.mark.parametrize("ranges", [1, 5])
def test_random_points(spark, ranges):
    rng = np.random.default_rng(ranges)
    rows = [(float(rng.integers(0, 60)) / 7, float(v), float(rng.integers(1, 4))) for v in rng.normal(size=150)]
    rows = [(x, y + x / 3, w) for x, y, w in rows] + [(None, 1.0, 1.0), (1.0, None, 1.0), (2.0, 5.0, 0.0), (3.0, 9.0, -1.0)]
    check(spark, rows, ranges)


@pytest.mark.parametrize("shape", ["rising", "falling", "late_low", "early_high", "constant"])
def test_shapes_that_pool_across_ranges(spark, shape):
    n = 60
    y = {"rising": range(n), "falling": range(n, 0, -1), "late_low": [*range(n - 1), -1000],
         "early_high": [1000, *range(n - 1)], "constant": [1] * n}[shape]
    rows = [(float(i), float(v), 1.0) for i, v in enumerate(y)]
    check(spark, rows, 6)


def test_nothing_and_one_point(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "x double, y double")
    assert [tuple(r) for r in isotonic.isotonic_blocks(df, "x", "y").collect()] == [(2.0, 2.0, 1.0, 3.0)]
    assert isotonic.isotonic_blocks(df.limit(0), "x", "y").count() == 0


def test_hull_drops_points_on_a_line():
    w, s = np.arange(6.0), np.array([0.0, 1.0, 2.0, 3.0, 2.0, 9.0])
    assert isotonic.lower_hull(w, s) == [0, 4, 5]
    assert isotonic.lower_hull(np.arange(4.0), np.arange(4.0)) == [0, 3]
