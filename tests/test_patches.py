"""Patches against dense arrays, and the patch search against loops."""

import itertools
import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from stratlas.functions import geometry as G
from stratlas.operators import patches, voxels

AFFINE = [[0.5, 0, 0, -8.0], [0, 0.5, 0, -2.0], [0, 0, 0.25, -5.0], [0, 0, 0, 1]]
POINT = "struct<x:double,y:double,z:double>"
PATCH = f"id string, c0 {POINT}, c1 {POINT}, c2 {POINT}, c3 {POINT}"


def _volume(spark, shape, seed=0, keep=0.7):
    rng = np.random.default_rng(seed)
    dense = rng.random(shape) * (rng.random(shape) < keep)
    rows = [(int(i), int(j), int(k), float(dense[i, j, k])) for i, j, k in np.argwhere(dense)]
    return dense, spark.createDataFrame(rows, "x int, y int, z int, value double")


def _corners(centre, u, v, length, width):
    c, u, v = (np.array(a, dtype=float) for a in (centre, u, v))
    u, v = u / np.linalg.norm(u) * length / 2, v / np.linalg.norm(v) * width / 2
    return [tuple(map(float, p)) for p in (c + u + v, c - u + v, c - u - v, c + u - v)]


def _linear(dense, q):
    base = np.floor(q).astype(int)
    out = 0.0
    for o in itertools.product((0, 1), repeat=3):
        at = base + o
        if all(0 <= a < n for a, n in zip(at, dense.shape, strict=True)):
            out += dense[tuple(at)] * np.prod([f if b else 1 - f for b, f in zip(o, q - base, strict=True)])
    return out


def _turned(dense, corners, flat=None):
    """The image on its own grid turned about the patch's centre: by matrices, pixel by pixel."""
    c, a = np.array(corners), np.array(AFFINE)
    centre = c.mean(0)
    u = (c[0] - c[1]) / np.linalg.norm(c[0] - c[1])
    n = np.cross(u, c[3] - c[0])
    n /= np.linalg.norm(n) * np.sign(n[np.argmax(np.abs(n))])
    turn, to, back = np.eye(4), np.eye(4), np.eye(4)
    turn[:3, :3] = np.array([u, n, np.cross(u, n)]).T
    to[:3, 3], back[:3, 3] = centre, -centre
    whole = to @ turn @ back @ a
    low = np.floor((np.linalg.inv(a) @ [*c.min(0), 1])[:3] + 1e-12)
    pixels = np.array([np.trunc((np.linalg.inv(whole) @ [*p, 1])[:3] - low) for p in c])
    first, last = (low + pixels.min(0) + 1), (low + pixels.max(0) - 1)
    out = {}
    height = (centre[1] - a[1, 3]) / a[1, 1]
    for i in range(int(last[0] - first[0])):
        for k in range(int(last[2] - first[2])):
            q = (np.linalg.inv(a) @ whole @ [first[0] + i, height, first[2] + k, 1])[:3]
            if flat is not None:
                q[flat] = np.round(q[flat])
            if (value := _linear(dense, q)) > 1e-12:
                out[i, k] = value
    return out


def _same(got, want):
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want)


@pytest.mark.parametrize(
    ("u", "v"),
    [((1, 0, 0.37), (-0.37, 0, 1)), ((-1, 0, 0.2), (0.2, 0, 1)), ((0, 0, 1), (1, 0, 0)), ((0.6, 0.3, 0.2), (-0.3, 0.6, 0.1)), ((0.1, 1, 0), (0, 0, -1))],
)
def test_extraction_in_any_direction(spark, u, v):
    dense, table = _volume(spark, (33, 9, 41))
    corners = _corners((0.13, 0.21, 0.17), u, np.cross(np.cross(u, v), u), 9.3, 6.1)
    got = patches.extract(spark.createDataFrame([("p", *corners)], PATCH), table, AFFINE, "id", size=8).collect()
    want = _turned(dense, corners)
    assert want
    _same({(r.i, r.k): r.value for r in got}, want)


def test_extraction_of_flat_images(spark):
    """Each patch from the section it names; a patch beyond the image has no pixels, nor one without area or corners."""
    dense, a = _volume(spark, (33, 1, 41), 1)
    other, b = _volume(spark, (33, 1, 41), 2)
    table = a.withColumn("section", F.lit("a")).union(b.withColumn("section", F.lit("b")))
    c = _corners((0.1, -1.9, 0.2), (1, 0, 0.4), (-0.4, 0, 1), 8.0, 5.0)
    away = _corners((300.0, -1.9, 0.2), (1, 0, 0.4), (-0.4, 0, 1), 8.0, 5.0)
    rows = [("1", *c, "a"), ("2", *c, "b"), ("3", *away, "a"), ("4", *[c[0]] * 4, "a"), ("5", None, *c[1:], "a")]
    got = patches.extract(spark.createDataFrame(rows, PATCH + ", section string"), table, AFFINE, "id", flat=1, on=["section"]).collect()
    assert {r.id for r in got} == {"1", "2"}
    for id, image in (("1", dense), ("2", other)):
        _same({(r.i, r.k): r.value for r in got if r.id == id}, _turned(image, c, flat=1))


def test_large_patches_are_dealt_in_tiles(spark, monkeypatch):
    dense, table = _volume(spark, (33, 9, 41))
    c = _corners((0.0, 0.25, 0.0), (1, 0, 0.3), (-0.3, 0, 1), 12.0, 8.0)
    p = spark.createDataFrame([("p", *c)], PATCH)
    whole = {(r.i, r.k): r.value for r in patches.extract(p, table, AFFINE, "id").collect()}
    monkeypatch.setattr(patches, "TILE", 5)
    _same({(r.i, r.k): r.value for r in patches.extract(p, table, AFFINE, "id", size=4).collect()}, whole)
    _same(whole, _turned(dense, c))


def test_extraction_reads_crossed_blocks_only(spark, tmp_path):
    _, table = _volume(spark, (33, 9, 41))
    voxels.with_blocks(table, 8).write.partitionBy("bx", "by", "bz").parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    c = _corners((-6.0, 0.25, -3.0), (1, 0, 0.3), (-0.3, 0, 1), 2.5, 2.0)
    got = patches.extract(spark.createDataFrame([("p", *c)], PATCH), stored, AFFINE, "id", size=8)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    want = patches.extract(spark.createDataFrame([("p", *c)], PATCH), table, AFFINE, "id").collect()
    assert want
    _same({(r.i, r.k): r.value for r in got.collect()}, {(r.i, r.k): r.value for r in want})


def test_turned_affines_are_refused(spark):
    with pytest.raises(ValueError, match="axes"):
        patches.frames(spark.createDataFrame([], PATCH), G.rotation_y(0.3))


def test_image_planes(spark):
    rows = [("y", [0.5, 0, 0, 1.0, 0, 2.0, 0, 3.0, 0, 0, 0.25, 4.0], 30, 1, 40), ("x", [0.5, 0, 0, 1.0, 0, 2.0, 0, 3.0, 0, 0, 0.25, 4.0], 1, 30, 40), ("oblique", [0.6, 0, -0.8, 1.0, 0, 2.0, 0, 3.0, 0.8, 0, 0.6, 4.0], 40, 30, 1), ("tie", [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 7.0], 5, 5, 5), ("none", [0.0] * 12, 5, 5, 1)]
    rows = [(id, [float(a) for a in affine], *shape) for id, affine, *shape in rows]
    got = {r.id: r for r in patches.image_planes(spark.createDataFrame(rows, "id string, affine array<double>, sx int, sy int, sz int")).collect()}
    for id, affine, *shape in rows[:4]:
        a, flat = np.array(affine).reshape(3, 4), int(np.argmin(shape))
        i, j = (c for c in range(3) if c != flat)
        n, d = G.plane_through([a[:, 3], a[:, 3] + a[:, i], a[:, 3] + a[:, j]])
        assert np.allclose([got[id].nx, got[id].ny, got[id].nz, got[id].d], [*n, d])
    assert got["none"].nx is None and got["none"].d is None


def _enclosing(points, n, d, margin):
    n = np.array(n)
    p = np.array(points)
    p = p - np.outer(p @ n - d, n)
    _, vectors = np.linalg.eigh((p - p.mean(0)).T @ (p - p.mean(0)))
    axes = []
    for v in (vectors[:, 2], np.cross(n, vectors[:, 2])):
        lead = next(x for x in v if abs(x) > 1e-9)
        axes.append(v * np.sign(lead))
    v1, v2 = axes
    p0, p1, p2, p3 = (p[min(range(len(p)), key=lambda i: (round(float(sign * p[i] @ v), 9), *p[i]))] for v in (v1, v2) for sign in (1, -1))  # noqa: B023
    half = np.linalg.norm(p3 - p2) / 2 + margin[1]
    return [p1 + half * v2 + margin[0] * v1, p0 + half * v2 - margin[0] * v1, p0 - half * v2 - margin[0] * v1, p1 - half * v2 + margin[0] * v1]


def test_enclosing_patches(spark):
    rng = np.random.default_rng(5)
    planes = {"a": (0.0, -1.0, 0.0, 0.4), "b": (0.6, 0.0, 0.8, 0.1), "c": (1.0, 0.0, 0.0, 0.0), "d": (0.0, 0.6, -0.8, -2.0)}
    points = {g: (rng.normal(size=(30, 3)) * (3, 2, 1)).tolist() for g in planes}
    rows = [(g, *p, *planes[g]) for g in planes for p in points[g]] + [("a", None, 1.0, 1.0, *planes["a"]), ("one", 1.0, 2.0, 3.0, *planes["a"]), (None, 1.0, 2.0, 3.0, *planes["a"])]
    got = {r.g: r for r in patches.enclosing_patches(spark.createDataFrame(rows, "g string, x double, y double, z double, nx double, ny double, nz double, d double"), ["g"], (0.5, 0.25)).collect()}
    assert set(got) == {*planes, "one", None}
    for g, (*n, d) in planes.items():
        want = _enclosing(points[g], n, d, (0.5, 0.25))
        assert np.allclose([list(got[g][c]) for c in patches.CORNERS], want) and got[g].points == 30
        assert got[g].axis_aligned == (g == "a")
    one = np.array([list(got["one"][c]) for c in patches.CORNERS])
    assert np.allclose(one.mean(0), (1, -0.4, 3)) and np.allclose(np.linalg.norm(one[0] - one[1]), 1) and np.allclose(np.linalg.norm(one[1] - one[2]), 0.5)


def test_flip_twice(spark):
    c = _corners((0, 0, 0), (1, 0, 0.4), (-0.4, 0, 1), 8.0, 5.0)
    p = spark.createDataFrame([("p", *c)], PATCH)
    once = patches.flip(p)
    assert [tuple(once.first()[k]) for k in patches.CORNERS] == [c[2], c[3], c[0], c[1]]
    assert patches.flip(once).collect() == p.collect()


def _sphere(n, m, radius, centre):
    verts = [(centre[0] + radius * math.sin(math.pi * i / n) * math.cos(2 * math.pi * j / m), centre[1] + radius * math.cos(math.pi * i / n), centre[2] + radius * math.sin(math.pi * i / n) * math.sin(2 * math.pi * j / m)) for i in range(1, n) for j in range(m)]
    at = lambda i, j: i * m + j % m
    faces = [f for i in range(n - 2) for j in range(m) for f in ((at(i, j), at(i + 1, j), at(i, j + 1)), (at(i + 1, j), at(i, j + 1), at(i + 1, j + 1)))]
    return verts, faces


@pytest.mark.parametrize("threshold", [0.0, 0.5])
def test_surface_patches(spark, threshold):
    """Two surfaces of three layers; one of them is far from the image, and one section beyond it."""
    layers, faces, places = [], [], {}
    for mesh, centre in (("left", (-2.0, 0.0, 0.0)), ("right", (40.0, 0.0, 0.0))):
        for layer, radius in (("3", 2.2), ("4", 2.0), ("5", 1.7)):
            verts, f = _sphere(9, 11, radius, centre)
            places[mesh, layer] = np.array([(x + 0.02 * i % 0.3, y, z * (1 + 0.03 * int(layer))) for i, (x, y, z) in enumerate(verts)])
            layers += [(mesh, layer, i, *map(float, p)) for i, p in enumerate(places[mesh, layer])]
        faces += [(mesh, *v) for v in f]
    heights = {"s1": 0.31, "s2": -0.77, "far": 30.0}
    sections = [(s, [0.1, 0, 0, -9.0, 0, 0.1, 0, y, 0, 0, 0.1, -9.0], 180, 1, 180, -9.0, y, -9.0, 9.0, y + 0.1, 9.0) for s, y in heights.items()]
    sections.append(("slanted", [0.1, 0.05, 0, -9.0, 0, 0.1, 0.02, 0.0, 0, 0, 0.1, -9.0], 180, 1, 180, -9.0, 0.0, -9.0, 9.0, 3.0, 9.0))
    sections = [(s, [float(a) for a in affine], *rest) for s, affine, *rest in sections]
    affine = [[1.0, 0, 0, -8.0], [0, 1.0, 0, -8.0], [0, 0, 1.0, -8.0], [0, 0, 0, 1]]
    rng = np.random.default_rng(3)
    dense = rng.random((16, 16, 16)) * (rng.random((16, 16, 16)) < 0.6)
    rows = [(int(i), int(j), int(k), float(dense[i, j, k])) for i, j, k in np.argwhere(dense)]
    got = patches.surface_patches(
        spark.createDataFrame(sections, "section string, affine array<double>, sx int, sy int, sz int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"),
        spark.createDataFrame(layers, "mesh string, layer string, vid int, x double, y double, z double"),
        spark.createDataFrame(faces, "mesh string, v0 int, v1 int, v2 int"),
        "4", spark.createDataFrame(rows, "x int, y int, z int, value double"), affine, threshold,
    ).collect()

    want = {}
    middle = places["left", "4"]
    edges = {tuple(sorted(e)) for _, *v in [f for f in faces if f[0] == "left"] for e in itertools.combinations(v, 2)}
    for s in ("s1", "s2"):
        y = heights[s]
        for a, b in edges:
            p, q = middle[a], middle[b]
            if (-p[1] >= -y) == (-q[1] >= -y):
                continue
            at = p + (y - p[1]) / (q[1] - p[1]) * (q - p)
            v = np.trunc([at[0] + 8, y + 8, at[2] + 8]).astype(int)
            value = dense[tuple(v)] if all(0 < c < 16 for c in v) else 0.0
            if value >= threshold:
                vid = int(np.argmin(np.linalg.norm(middle - at, axis=1)))
                line = [places["left", k][vid] for k in "345"]
                want[s, round(at[0], 6), round(at[2], 6)] = (vid, value, line, _enclosing(line, (0, -1, 0), -y, (0.5, 0.5)))
    assert want and len(got) == len(want) and {r.mesh for r in got} == {"left"}
    assert [r.relevance for r in got] == sorted((r.relevance for r in got), reverse=True)
    for r in got:
        vid, value, line, corners = want[r.section, round(r.x, 6), round(r.z, 6)]
        assert (r.vid, r.relevance) == (vid, value) and np.allclose([list(p["at"]) for p in r.profile], line)
        assert np.allclose([list(r[c]) for c in patches.CORNERS], corners, atol=1e-6)


def test_surface_patches_without_rows(spark):
    empty = lambda kinds: spark.createDataFrame([], kinds)
    got = patches.surface_patches(empty("section string, affine array<double>, sx int, sy int, sz int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"), empty("mesh string, layer string, vid int, x double, y double, z double"), empty("mesh string, v0 int, v1 int, v2 int"), "4", empty("x int, y int, z int, value double"), AFFINE)
    assert got.count() == 0
