"""Regions assigned to regions, and volumes stored at several scales."""

import re

import numpy as np
import pytest

from stratlas.operators import assignment
from stratlas.sources import pyramids

BOX = "x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"


def _block(name, low, high):
    return [(name, x, y, z) for x in range(low[0], high[0]) for y in range(low[1], high[1]) for z in range(low[2], high[2])]


def test_regions_by_masks_and_boxes(spark):
    a = _block("whole", (0, 0, 0), (4, 4, 4)) + _block("left", (0, 0, 0), (2, 4, 4)) + _block("away", (50, 0, 0), (51, 1, 1)) + _block("left", (0, 0, 0), (1, 1, 1)) + [(None, 0, 0, 0), ("left", None, 0, 0)]
    b = _block("whole", (0, 0, 0), (4, 4, 4)) + _block("mid", (1, 0, 0), (3, 4, 4))
    boxes = [("boxed", 0.0, 0.0, 0.0, 2.0, 4.0, 4.0), ("touching", 4.0, 0.0, 0.0, 6.0, 4.0, 4.0), ("mid", 0.0, 0.0, 0.0, 90.0, 90.0, 90.0)]
    got = assignment.assign_regions(spark.createDataFrame(a, "a string, x int, y int, z int"), spark.createDataFrame(b, "b string, x int, y int, z int"), "a", "b", b_boxes=spark.createDataFrame(boxes, "b string, " + BOX))
    assert {tuple(r) for r in got.collect()} == {
        ("whole", "whole", "EXACT", 64, "mask"), ("whole", "mid", "CONTAINS", 32, "mask"), ("left", "whole", "CONTAINED", 32, "mask"), ("left", "mid", "OVERLAPS", 16, "mask"),
        ("left", "boxed", "EXACT", None, "box"), ("whole", "boxed", "CONTAINS", None, "box"),
    }


def test_regions_against_sets(spark):
    rng = np.random.default_rng(0)
    masks = [{f"{s}{i}": {tuple(map(int, p)) for p in rng.integers(0, 4, (int(rng.integers(1, 60)), 3))} for i in range(12)} for s in "pq"]
    tables = [spark.createDataFrame([(k, *p) for k, ps in m.items() for p in ps], f"{c} string, x int, y int, z int") for c, m in zip("ab", masks, strict=True)]
    want = set()
    for i, p in masks[0].items():
        for j, q in masks[1].items():
            if p & q:
                want.add((i, j, "EXACT" if p == q else "CONTAINED" if p < q else "CONTAINS" if q < p else "OVERLAPS", len(p & q), "mask"))
    assert {tuple(r) for r in assignment.assign_regions(*tables, "a", "b").collect()} == want
    assert assignment.assign_regions(tables[0].limit(0), tables[1], "a", "b").count() == 0


def _halved(dense):
    dense = np.pad(dense, [(0, n % 2) for n in dense.shape])
    return dense.reshape(*[s for n in dense.shape for s in (n // 2, 2)]).mean((1, 3, 5))


@pytest.fixture(scope="module")
def dense():
    rng = np.random.default_rng(1)
    return rng.random((19, 8, 13)) * (rng.random((19, 8, 13)) < 0.3)


def _table(spark, dense):
    return spark.createDataFrame([(int(i), int(j), int(k), float(dense[i, j, k])) for i, j, k in np.argwhere(dense)], "x int, y int, z int, value double")


def _same(rows, dense):
    got = {(r.x, r.y, r.z): r.value for r in rows}
    assert set(got) == {tuple(map(int, p)) for p in np.argwhere(dense)} and all(abs(got[p] - dense[p]) < 1e-12 for p in got)


@pytest.mark.parametrize("labels", [False, True])
def test_pyramid(spark, tmp_path, dense, labels):
    table = _table(spark, dense)
    odd = spark.createDataFrame([(-1, 0, 0, 5.0), (19, 0, 0, 5.0), (None, 0, 0, 5.0), (0, 0, 0, None)], table.schema)
    scales = pyramids.write_pyramid(table.union(odd), str(tmp_path / "p"), 0.5, dense.shape, 4, labels, 4)
    want = dense
    for k, scale in enumerate(scales):
        assert (scale.resolution_mm, scale.sx, scale.sy, scale.sz) == (0.5 * 2**k, *want.shape)
        got, at = pyramids.read_pyramid(spark, str(tmp_path / "p"), 0.5 * 2**k + 0.01)
        assert got == scale
        _same(at.collect(), want)
        want = want[::2, ::2, ::2] if labels else _halved(want)


def test_pyramid_boxes(spark, tmp_path, dense):
    folder = str(tmp_path / "p")
    pyramids.write_pyramid(_table(spark, dense), folder, 0.5, dense.shape, 3, block=4)
    box = ((0.6, 1.0, -3.0), (4.0, 2.2, 3.1))
    scale, at = pyramids.read_pyramid(spark, folder, 0.7, box)
    inside = np.zeros_like(dense)
    inside[1:8, 2:5, 0:7] = dense[1:8, 2:5, 0:7]
    assert scale.scale == 0
    _same(at.collect(), inside)
    plan = at._jdf.queryExecution().executedPlan().toString()
    assert all(re.search(rf"PartitionFilters: \[[^\]]*{c}#", plan) for c in ("bx", "by", "bz"))
    # A cap makes the scale coarser, for the box and not for the whole volume.
    small, _ = pyramids.read_pyramid(spark, folder, 0.7, box, max_bytes=8 * 7 * 3 * 7)
    less, _ = pyramids.read_pyramid(spark, folder, 0.7, box, max_bytes=8 * 7 * 3 * 7 - 1)
    assert (small.scale, less.scale) == (0, 1)
    away, none = pyramids.read_pyramid(spark, folder, None, ((90.0, 0.0, 0.0), (95.0, 1.0, 1.0)))
    assert away.scale == 0 and none.count() == 0


def test_choice_of_scales():
    scales = [pyramids.Scale(k, 0.5 * 2**k, 64 >> k, 64 >> k, 64 >> k) for k in range(4)]
    assert [pyramids.choose(scales, r).scale for r in (None, -1, 0.5, 0.99, 1.0, 100)] == [0, 0, 0, 0, 1, 3]
    assert pyramids.choose(scales[::-1], 1.0, max_bytes=8 * 16**3).scale == 2
    with pytest.raises(ValueError, match="resolves"):
        pyramids.choose(scales, 0.4)
    with pytest.raises(ValueError, match="fits"):
        pyramids.choose(scales, 0.5, max_bytes=100)


def test_empty_pyramid(spark, tmp_path):
    pyramids.write_pyramid(spark.createDataFrame([], "x int, y int, z int, value double"), str(tmp_path / "p"), 1.0, (4, 4, 4), 2)
    assert pyramids.read_pyramid(spark, str(tmp_path / "p"))[1].count() == 0
