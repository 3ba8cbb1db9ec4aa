"""Rasters of polygons against point-in-polygon tests in whole numbers."""

import random
from fractions import Fraction

import pytest

from stratlas.operators import polygons


def _inside(rings, x, y):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            ax, ay, bx, by = map(Fraction, (ax, ay, bx, by))
            if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return True
            if (ay <= y) != (by <= y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                odd = not odd
    return odd


def _want(rings, size=24):
    return {(x, y) for x in range(-4, size) for y in range(-4, size) if _inside(rings, x, y)}


_random = random.Random(4)
SHAPES = {
    "square": [[(2, 2), (9, 2), (9, 9), (2, 9)]],
    "hole": [[(0, 0), (15, 0), (15, 15), (0, 15)], [(4, 4), (11, 5), (10, 11)]],
    "star": [[(8, 0), (12, 15), (0, 5), (16, 5), (3, 15)]],
    "apex": [[(5, 0), (10, 7), (5, 3), (0, 7)]],
    "between": [[(1.25, 1.5), (7.75, 2.5), (3.5, 8.25)]],
    "thin": [[(0, 0), (10, 5), (10, 5)]],
    "left of zero": [[(-3, -2), (4, -3), (2.5, 4)]],
    **{f"random{i}": [[(_random.randrange(80) / 4, _random.randrange(80) / 4) for _ in range(_random.randrange(3, 12))] for _ in range(1 + i % 2)] for i in range(8)},
}


def test_rasters(spark):
    rows = [(name, r, k, float(x), float(y)) for name, rings in SHAPES.items() for r, ring in enumerate(rings) for k, (x, y) in enumerate(ring)]
    got = {}
    for p in polygons.raster(spark.createDataFrame(rows, "polygon string, ring int, k int, x double, y double")).collect():
        assert (p.x, p.y) not in got.setdefault(p.polygon, set())
        got[p.polygon].add((p.x, p.y))
    for name, rings in SHAPES.items():
        assert got.get(name, set()) == _want(rings), name


def test_raster_of_nothing(spark):
    assert polygons.raster(spark.createDataFrame([("a", 0, 0, None, 1.0)], "polygon string, ring int, k int, x double, y double")).count() == 0


@pytest.mark.parametrize("missing", [None, 3])
def test_layer_mask(spark, missing):
    size, rng = (17, 21), random.Random(1)
    lines = {b: [(rng.randrange(-1, 76) / 4, 2.5 * b + rng.randrange(8) / 4) for _ in range(5)] for b in range(7) if b != missing}
    got = polygons.layer_mask(spark.createDataFrame([("i", b, *p) for b, ps in lines.items() for p in ps] + [("i", 0, None, 1.0)], "image string, boundary int, x double, y double"), spark.createDataFrame([("i", *size), ("blank", 3, 3)], "image string, sx int, sy int"))
    trimmed = {b: [(0.0 if k == 0 else min(x, size[0]), min(y, size[1])) for k, (x, y) in enumerate(sorted(ps))] for b, ps in lines.items()}
    trimmed[7] = [(0, size[1]), size]
    want = {}
    for layer in range(1, 8):
        if layer - 1 in trimmed and layer in trimmed:
            ring = trimmed[layer - 1] + trimmed[layer][::-1]
            want |= {("i", x, y): layer for x in range(size[0] + 1) for y in range(size[1] + 1) if _inside([ring], x, y)}
    assert {(r.image, r.x, r.y): r.layer for r in got.collect()} == want
