"""The search for nearest targets: exact on odd clouds, and its work follows the input."""

import math
import random

import pytest

from stratlas.operators import locations, patches

XYZ = "x double, y double, z double"


def _joined(plan):
    """Rows that the joins of an executed plan gave."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return _joined(plan.executedPlan())
    if "QueryStage" in name:
        return _joined(plan.plan())
    metric = plan.metrics().get("numOutputRows")
    rows = metric.get().value() if "Join" in name and metric.isDefined() else 0
    return rows + sum(_joined(plan.children().apply(i)) for i in range(plan.children().size()))


@pytest.fixture
def joined(monkeypatch):
    """The number of joined rows of each table that the search has written."""
    rows, write = [], locations.materialise

    def counted(df):
        out = write(df)
        rows.append(_joined(df._jdf.queryExecution().executedPlan()))
        return out

    monkeypatch.setattr(locations, "materialise", counted)
    return rows


def _sheet(n):
    """A square of n by n vertices with its faces, all within one unit."""
    verts = [(i * n + j, i / n, j / n - 0.5, 0.01 * ((i * 7 + j * 3) % 5)) for i in range(n) for j in range(n)]
    at = lambda i, j: i * n + j
    return verts, [f for i in range(n - 1) for j in range(n - 1) for f in ((at(i, j), at(i + 1, j), at(i, j + 1)), (at(i + 1, j), at(i, j + 1), at(i + 1, j + 1)))]


def test_surface_patches_compare_no_surface_with_all_its_crossings(spark, joined):
    """1,600 vertices in one cell, of which each crossing of the section takes the nearest: all were compared with all."""
    image = spark.createDataFrame([(i, j, k, 1.0) for i in range(1, 6) for j in range(1, 6) for k in range(1, 6)], "x int, y int, z int, value double")
    affine = [[1.0, 0, 0, -3.0], [0, 1.0, 0, -3.0], [0, 0, 1.0, -3.0], [0, 0, 0, 1]]
    sections = spark.createDataFrame([("s", [0.1, 0.0, 0.0, -2.0, 0.0, 0.1, 0.0, 0.003, 0.0, 0.0, 0.1, -2.0], 40, 1, 40, -2.0, -0.05, -2.0, 2.0, 0.05, 2.0)], "section string, affine array<double>, sx int, sy int, sz int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    verts, faces = _sheet(40)
    layers = [("m", layer, v, x, y, z + up) for v, x, y, z in verts for layer, up in (("3", 0.1), ("4", 0.0), ("5", -0.2))]
    got = patches.surface_patches(sections, spark.createDataFrame(layers, f"mesh string, layer string, vid int, {XYZ}"), spark.createDataFrame([("m", *f) for f in faces], "mesh string, v0 int, v1 int, v2 int"), "4", image, affine).collect()
    assert len(got) > 60
    for r in got:
        assert r.vid == min(verts, key=lambda v: (math.dist(v[1:], (r.x, r.y, r.z)), v[0]))[0]
    assert max(joined) < 300 * len(got)


def _search(spark, points, targets):
    table = lambda rows, name: spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rows)], f"{name} int, {XYZ}")
    return {r.p: (r.t, r.distance) for r in locations.nearest(table(points, "p"), table(targets, "t"), "p", "t", 1.0).collect()}


def _brute(points, targets):
    # sum() would add more exactly than the columns do, and ties would differ.
    length = lambda p, t: math.sqrt((p[0] - t[0]) * (p[0] - t[0]) + (p[1] - t[1]) * (p[1] - t[1]) + (p[2] - t[2]) * (p[2] - t[2]))
    return {i: min((length(p, t), k) for k, t in enumerate(targets))[::-1] for i, p in enumerate(points)}


@pytest.mark.parametrize("far", [False, True])
def test_nearest_takes_few_targets_of_a_dense_cloud(spark, joined, far):
    """All in one cell, or half of the points far from the dense cloud: 4,000 targets, and a point meets a few hundred nodes at most."""
    rng = random.Random(5)
    points = [[rng.gauss(30 if far and i % 2 else 0.5, 0.1) for _ in "xyz"] for i in range(100)]
    targets = [[rng.gauss(0.5, 0.1) for _ in "xyz"] for _ in range(4000)]
    assert _search(spark, points, targets) == _brute(points, targets)
    assert max(joined) < 600 * len(points)


def test_rows_of_a_point_hardly_grow_with_the_targets(spark, joined):
    """Eight times the targets in the same place: a task holds the joined rows of its points, which grew as much."""
    rng = random.Random(3)
    points = [[rng.gauss(0.5, 0.1) for _ in "xyz"] for _ in range(200)]
    most = []
    for n in (1000, 8000):
        joined.clear()
        targets = [[rng.gauss(0.5, 0.1) for _ in "xyz"] for _ in range(n)]
        assert _search(spark, points, targets) == _brute(points, targets)
        most.append(max(joined))
    assert most[1] < 3 * most[0]


@pytest.mark.parametrize("some", ["points", "targets", None])
def test_nearest_without_points_or_targets(spark, some):
    table = lambda name: spark.createDataFrame([(1, 0.0, 0.0, 0.0)] if some == name else [], f"{name} int, {XYZ}")
    got = locations.nearest(table("points"), table("targets"), "points", "targets", 1.0)
    assert got.columns == ["points", "targets", "distance"] and got.count() == 0


@pytest.mark.parametrize("shuffled", [False, True])
def test_nearest_on_odd_clouds(spark, monkeypatch, shuffled):
    """Ties, copies, clouds of very different sizes and neighbouring numbers; with levels sent to all executors, and joined by shuffles."""
    if shuffled:
        for name, bound in (("SEND_NODES", 3), ("SEND_TARGETS", 10), ("LEVELS_AT_ONCE", 2)):
            monkeypatch.setattr(locations, name, bound)
    rng = random.Random(9)
    lattice = lambda n: [[rng.randrange(5) for _ in "xyz"] for _ in range(n)]
    tiny = [[rng.gauss(0, 1e-9) for _ in "xyz"] for _ in range(150)] + [[rng.gauss(5, 1e-3) for _ in "xyz"] for _ in range(150)] + [[1e12, 0, 0], [-3e30, 1, 1]]
    close = [[1 + k * 2.0**-52, 0, 0] for k in range(60)]
    clouds = [(lattice(60), lattice(600)), (tiny[::7] + lattice(20), tiny), (close[::9], close), ([[0, 0, 0], [3, 2, 1]], [[1, 2, 3], [-1, 0, 0]] * 50), ([[0, 0, 0]], [[k * 5e-324, 0, 0] for k in range(40)])]
    for points, targets in clouds:
        assert _search(spark, points, targets) == _brute(points, targets)
