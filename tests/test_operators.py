"""Fixtures and properties of the operators that the driver's tables don't show."""

import gzip
import itertools
import json
import math
import random
import sqlite3
import zipfile

import numpy as np
import pytest

from pyspark.sql import functions as F

from stratlas.functions import geometry as G
from stratlas.functions import ids, names
from stratlas.operators import assignment, clusters, components, density, features, hierarchy, locations, meshes, registry, similarity, tabular, voxels
from stratlas.sources import chunks, files, sinks, specs


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


REGION = ("AREA_HOC1_V1_17_CALCS", "id1", "Area hOc1 (V1, 17, CalcS)")


@pytest.mark.parametrize(("spec", "want"), [("hoc1", True), ("Area hOc1 (V1, 17, CalcS)", True), ("occipital cortex", False), ("Area 51", False), ("id1", True), ("area 1", True), ("17 calcs", True)])
def test_region_match(spark, spec, want):
    key, id, name = map(F.lit, REGION)
    assert one(spark, lambda s: names.region_matches(s, key, id, name), spec) is want


def test_null_spec_matches_nothing(spark):
    assert one(spark, lambda s: names.region_matches(s, *map(F.lit, REGION)), None) is None


def test_names(spark):
    assert one(spark, names.create_key, " Area hOc1 (V1, 17) é ") == "AREA_HOC1_V1_17_É"
    assert one(spark, names.clear_name, "ctx-lh-cuneus  -  left hemisphere both") == "left cuneus left"
    assert one(spark, names.snake_to_camel, "JULY_BRAIN") == "JulyBrain"
    assert one(spark, names.trailing_uuid, "hello world/aabbcc-0099") == "aabbcc-0099"
    assert one(spark, names.parse_point, "1mm, -2.5mm, 3 mm") == [1.0, -2.5, 3.0] and one(spark, names.parse_point, "1mm") is None
    assert one(spark, names.group_members, "Group: a, b (c, d), e") == ["a", "b (c, d)", "e"]
    assert tuple(one(spark, names.rgb, "#ff8000")) == (255, 128, 0) and one(spark, names.rgb, "ff8000") is None
    with pytest.raises(ValueError):
        names.regex_matches("a", F.lit("a"), F.lit("a"), "z")


def test_duplicate_suffix(spark):
    rows = spark.createDataFrame(list(enumerate("abacba")), "pos int, name string")
    assert [r.unique_label for r in tabular.unique_labels(rows, "name", "pos").orderBy("pos").collect()] == ["a", "b", "a*", "c", "b*", "a**"]


def test_number_codec(spark):
    values = [0, 1, 63, 64, -1, -64, 2**40, -(2**31), 123456789]
    df = spark.createDataFrame([(v,) for v in values], "v long").withColumn("e", ids.encode_number(F.col("v")))
    got = {r.v: (r.e, r.d) for r in df.withColumn("d", ids.decode_number(F.col("e"))).collect()}
    assert all(got[v][1] == v for v in values) and got[64][0] == "10" and got[-1][0] == "1~" and got[0][0] == "0"
    assert one(spark, ids.decode_number, "a b") is None


def test_name_hash_overflows(spark):
    def plain(name):
        h = 0
        for c in name:
            h = ((h << 5) - h + ord(c)) & 0xFFFFFFFF
            h -= (h & 0x80000000) << 1
        return hex(h)[3:]

    given = ["", "a", "Area 4p (PreCG) right", "é\U0001f600 left", "\n x", *[f"Area {i} {'x' * i}" for i in range(60)]]
    got = spark.createDataFrame([(i, n) for i, n in enumerate(given)], "i int, n string").select("i", ids.name_hash(F.col("n")).alias("h")).collect()
    assert {r.i: r.h for r in got} == {i: plain(n) for i, n in enumerate(given)}
    assert plain("") == "" and len(plain("Area 4p (PreCG) right")) >= 5


TREE = [("r", None, "brain"), ("a", "r", "occipital cortex"), ("b", "r", "frontal"), ("a1", "a", "Area hOc1"), ("a2", "a", "Area hOc2"), ("b1", "b", "Area 4p")]


@pytest.fixture(scope="module")
def tree(spark):
    return hierarchy.with_paths(spark.createDataFrame(TREE, "id string, parent string, name string")).cache()


def test_hierarchy(spark, tree):
    find = lambda match, **how: {r.id for r in hierarchy.find(tree, match, **how).collect()}
    area = F.contains("name", F.lit("Area"))
    assert find(area) == find(area, filter_children=True) == {"a1", "a2", "b1"}
    assert find(area, filter_children=True, find_topmost=True) == {"a", "b"}
    assert find(area | (F.col("id") == "a"), filter_children=True) == {"a", "b1"}
    assert {r.id: r.depth for r in hierarchy.subtree(tree, "a").collect()} == {"a": 0, "a1": 1, "a2": 1}
    own = spark.createDataFrame([("s", "a1"), ("s", "a2"), ("t", "a1"), ("t", "b")], "space string, id string")
    assert {tuple(r) for r in hierarchy.covered(tree, own, "space").collect()} == {("s", "a1"), ("s", "a2"), ("s", "a"), ("t", "a1"), ("t", "b")}
    ranked = [r.id for r in hierarchy.ranked(hierarchy.find(tree, area), "Area 4p").collect()]
    assert ranked[0] == "b1"


def test_resolve(spark, tree):
    wanted = spark.createDataFrame([("brain",), ("hoc1",), ("area",), ("nothing",)], "spec string")
    match = names.region_matches(F.col("spec"), F.col("id"), F.col("id"), F.col("name"))
    got = {r.spec: (r.matches, r.id) for r in hierarchy.resolve(tree, wanted, match, key="id").collect()}
    assert got == {"brain": (1, "r"), "hoc1": (1, "a1"), "area": (3, None), "nothing": (0, None)}


def test_cycle_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "MAX_DEPTH", 3)
    deep = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(8)], "id string, parent string")
    with pytest.raises(ValueError, match="longer"):
        hierarchy.with_paths(deep)


def test_select_map(spark):
    maps = spark.createDataFrame([(0, "julia labelled", "s1", "p1", "LABELLED"), (1, "julia statistical", "s1", "p1", "STATISTICAL"), (2, "other", "s2", "p1", "LABELLED")], "ord int, id string, space_id string, parcellation_id string, maptype string")
    pick = lambda **k: [r.ord for r in registry.select_map(maps, **k).collect()]
    for space, kind, spec in itertools.product((None, "s1", "s2"), (None, "LABELLED", "STATISTICAL"), (None, "julia")):
        rows = [m for m in maps.collect() if space in (None, m.space_id) and kind in (None, m.maptype) and (spec or "") in m.id]
        assert pick(space=space, maptype=kind, spec=spec) == [r.ord for r in rows[:1]]


def test_affine():
    m = G.compose(G.translation((1, 2, 3)), G.rotation_y(0.3))
    assert np.allclose(np.array(G.inverse(m)), np.linalg.inv(np.array(m))) and math.isclose(G.affine_scaling(m), 1)
    corners = [tuple(float(v) for v in c) for c in itertools.product((0, 1), repeat=3)]
    moved = [tuple((np.array(m) @ [*c, 1])[:3]) for c in corners]
    assert np.allclose(G.estimate_affine(list(zip(corners, moved, strict=True))), m)
    n, d = G.plane_through([(0, 0, 1), (1, 0, 1), (0, 1, 1)])
    assert np.allclose(np.abs(n), (0, 0, 1)) and math.isclose(abs(d), 1)
    assert math.isclose(sum(w for *_, w in G.gaussian_kernel(1.0)), 1)


def test_box_sets(spark):
    row = lambda i, *b: (i, *map(float, b))
    schema = "id int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"
    a = spark.createDataFrame([row(1, 0, 0, 0, 2, 2, 2), row(2, -5, -5, -5, 5, 5, 5)], schema)
    b = spark.createDataFrame([row(7, 1, 1, 1, 3, 3, 3), row(8, 2, 0, 0, 4, 2, 2), row(9, 0, 0, 0, 2, 2, 2)], schema)
    got = {(r.a, r.b): (r.x0, r.x1) for r in locations.intersect_boxes(a.withColumnRenamed("id", "a"), b.withColumnRenamed("id", "b"), "a", "b").collect()}
    assert got == {(1, 7): (1, 2), (1, 9): (0, 2), (2, 7): (1, 3), (2, 8): (2, 4), (2, 9): (0, 2)}  # touching boxes share nothing
    p = spark.createDataFrame([(1, 2.0, 2.0, 2.0), (2, 2.1, 0.0, 0.0)], "idx int, x double, y double, z double")
    assert {(r.idx, r.id) for r in locations.points_in_boxes(p, a).collect()} == {(1, 1), (1, 2), (2, 2)}


def test_nearest_is_exact(spark):
    r = random.Random(3)
    rows = [(i, r.random() * 9, r.random() * 9, r.random()) for i in range(200)]
    p, t = rows[:100], rows[100:]
    got = locations.nearest(spark.createDataFrame(p, "p int, x double, y double, z double"), spark.createDataFrame(t, "t int, x double, y double, z double"), "p", "t", 0.1).collect()
    assert {g.p: g.t for g in got} == {a[0]: min(t, key=lambda b: math.dist(a[1:], b[1:]))[0] for a in p}


def blob(spark, cells):
    return spark.createDataFrame([("m", 0, None, *map(int, c), float(v)) for *c, v in cells], "map_id string, volume int, fragment string, x int, y int, z int, value double")


@pytest.mark.parametrize("connectivity", [1, 2, 3])
def test_components(spark, connectivity):
    rng = np.random.default_rng(1)
    mask = rng.random((7, 7, 7)) < 0.25
    cells = [tuple(c) for c in np.argwhere(mask).tolist()]
    group = {c: {c} for c in cells}
    for a, b in itertools.combinations(cells, 2):
        d = [abs(p - q) for p, q in zip(a, b, strict=True)]
        if max(d) == 1 and sum(d) <= connectivity and group[a] is not group[b]:
            group[a] |= group[b]
            for c in group[b]:
                group[c] = group[a]
    got = components.label_mask(blob(spark, [(*c, 1) for c in cells]), connectivity).collect()
    assert len(got) == len(cells)
    by = {}
    for r in got:
        by.setdefault(r.component, set()).add((r.x, r.y, r.z))
    assert sorted(map(sorted, by.values())) == sorted(map(list, {tuple(sorted(g)) for g in group.values()}))


def test_long_path_is_one_component(spark):
    nodes = spark.range(300).select("id")
    edges = nodes.filter("id < 299").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components.connected_components(nodes, edges).filter("component <> 0").isEmpty()


def test_depth_of_a_cube(spark):
    cube = blob(spark, [(*c, 1) for c in itertools.product(range(1, 6), repeat=3)])
    got = components.distance_to_background(cube).groupBy("depth").count().collect()
    assert {r.depth: r["count"] for r in got} == {1: 125 - 27, 2: 26, 3: 1}


def test_similarity_against_numpy(spark):
    rng = np.random.default_rng(5)
    a, b = (np.where(rng.random((6, 6, 6)) < 0.5, rng.random((6, 6, 6)), 0) for _ in range(2))
    frame = lambda x: blob(spark, [(*c, x[tuple(c)]) for c in np.argwhere(x > 0).tolist()])
    r = similarity.compare(similarity.paired(frame(a), frame(b)), size=216).first()
    assert math.isclose(r.correlation, np.corrcoef(a.ravel(), b.ravel())[0, 1], rel_tol=1e-9)
    assert math.isclose(r.iou, ((a > 0) & (b > 0)).sum() / ((a > 0) | (b > 0)).sum())
    assert 0 <= r.iou <= 1 and math.isclose(r.weighted_mean_of_a, (a * b).sum() / b.sum())
    same = similarity.compare(similarity.paired(frame(a), frame(a)), size=216).first()
    assert math.isclose(same.correlation, 1) and same.iou == 1


def test_resample_linear_keeps_mass(spark):
    v = blob(spark, [(2, 2, 2, 8.0)])
    grid = [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0], [0, 0, 0, 1]]
    half = [[1.0, 0, 0, 0.5], [0, 1.0, 0, 0], [0, 0, 1.0, 0], [0, 0, 0, 1]]
    got = voxels.resample_linear(v, grid, half).collect()
    assert {(r.x, r.value) for r in got} == {(1, 4.0), (2, 4.0)}


def test_draw_is_proportional(spark):
    v = blob(spark, [(0, 0, 0, 3.0), (1, 0, 0, 1.0), (2, 0, 0, 0.0)])
    got = {r.x: r["count"] for r in voxels.draw(v, 400).groupBy("x").count().collect()}
    assert sum(got.values()) == 400 and abs(got[0] - 300) <= 1


def test_blocks_prune(spark, tmp_path):
    v = blob(spark, [(i, 0, 0, 1.0) for i in range(0, 200, 10)])
    sinks.write_voxels(v, str(tmp_path / "v"))
    part = voxels.in_box(spark.read.parquet(str(tmp_path / "v")), (0, 0, 0), (50, 1, 1))
    assert part.count() == 5 and "PartitionFilters: [isnotnull" in part._jdf.queryExecution().toString()


def test_assignment_schema(spark):
    v = blob(spark, [(1, 1, 1, 0.5), (1, 1, 2, 0.9)])
    index = spark.createDataFrame([("m", "area", 0, None, None)], "map_id string, region string, volume int, fragment string, label double")
    grid = [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0], [0, 0, 0, 1]]
    p = spark.createDataFrame([(7, 1.2, 0.9, 1.4), (8, 9.0, 9.0, 9.0)], "idx int, x double, y double, z double")
    got = assignment.assign_points(p, v, index, grid)
    assert tuple(got.columns) == assignment.COLUMNS and [(r.input_structure, r.region, r.map_value) for r in got.collect()] == [(7, "area", 0.5)]
    image = assignment.assign_image(v, v, index).first()
    assert math.isclose(image.correlation, 1) and image.intersection_over_union == 1 and image.map_value == 0.9
    for code in range(1, 8):
        assert one(spark, lambda c: assignment.invert(assignment.invert(c)), code, "int") == code


def test_uncertain_points_one_by_one(spark):
    """Each point's own uncertainty decides between reading its voxel and comparing its blob, against sums over whole blobs."""
    rng = np.random.default_rng(5)
    cells = {v: {tuple(int(i) for i in rng.integers(0, 12, 3)): float(rng.uniform(0.1, 2)) for _ in range(150)} for v in (0, 1)}
    voxel = spark.createDataFrame([("m", v, None, *at, a) for v, c in cells.items() for at, a in c.items()], "map_id string, volume int, fragment string, x int, y int, z int, value double")
    index = spark.createDataFrame([("m", f"r{v}", v, None, None) for v in cells], "map_id string, region string, volume int, fragment string, label double")
    points = [(i, *(float(c) + 0.2 for c in list(cells[i % 2])[i]), s) for i, s in enumerate([None, 0.0, 0.7, 2.9, 3.0, 3.7, 4.8])] + [(7, 90.0, 9.0, 9.0, 3.5)]
    p = spark.createDataFrame(points, "idx int, x double, y double, z double, s double")
    grid = [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0], [0, 0, 0, 1]]
    want = {}
    for i, *at, s in points:
        here = tuple(int(c + 0.5) for c in at)
        for v, c in cells.items():
            if (s or 0) < 3:
                want |= {(i, v): (None, None, c[here], None, None, None, None)} if here in c else {}
                continue
            b = {tuple(a + d for a, d in zip(here, o, strict=True)): w for *o, w in G.gaussian_kernel(s)}
            if both := b.keys() & c.keys():
                n = math.prod(max(max(k[d] for k in c), max(k[d] for k in b) + 1) - min(min(k[d] for k in c), min(k[d] for k in b)) for d in range(3))
                sab, sa, sb = sum(b[k] * c[k] for k in both), sum(c.values()), sum(b.values())
                root = math.sqrt((sum(x * x for x in c.values()) - sa * sa / n) * (sum(x * x for x in b.values()) - sb * sb / n))
                want[i, v] = ((sab - sa * sb / n) / root, len(both) / (len(b) + len(c) - len(both)), max(c.values()), sab / sb, len(both) / len(c), sab / sa, len(both) / len(b))
    got = assignment.assign_uncertain(p, voxel, index, grid, "s").collect()
    assert {(r.input_structure, r.volume) for r in got} == set(want) and len(got) == len(want) and len(want) > 9
    for r in got:
        assert tuple(r)[5:] == pytest.approx(want[r.input_structure, r.volume]) and tuple(r.centroid) == points[r.input_structure][1:4]
    high = assignment.assign_uncertain(p, voxel, index, grid, "s", threshold=0.05).collect()
    assert {(r.input_structure, r.volume) for r in high} == {k for k, w in want.items() if (w[2] if w[1] is None else w[1]) > 0.05}


def test_uncertain_points_of_all_labels(spark, sf):
    from stratlas.plans import spatial

    cells = {(r.volume, r.x, r.y, r.z) for r in spatial.grid(spark, sf).collect()}
    want = set()
    for p in spatial.cloud(spark, sf).collect():
        at, s = [int(c * 8 + 8 + 0.5) for c in (p.x, p.y, p.z)], (p.idx % 7) / 10 * 8
        r = int(3 * s) if s >= 3 else 0
        want |= {(p.idx, v) for v, *c in cells if all(abs(a - b) <= r for a, b in zip(at, c, strict=True))}
    got = [(r.input_structure, r.volume) for r in spatial.assign_uncertain_points(spark, sf).collect()]
    assert set(got) == want and len(got) == len(want)


def test_plane_cut_of_a_tetrahedron(spark):
    verts = spark.createDataFrame([("m", 0, 0.0, 0.0, 0.0), ("m", 1, 1.0, 0.0, 0.0), ("m", 2, 0.0, 1.0, 0.0), ("m", 3, 0.0, 0.0, 1.0)], "mesh string, vid int, x double, y double, z double")
    faces = spark.createDataFrame([("m", i, *f) for i, f in enumerate(itertools.combinations(range(4), 3))], "mesh string, fid int, v0 int, v1 int, v2 int")
    got = meshes.plane_cut(verts, faces, (0.0, 0.0, 1.0), 0.5).collect()
    assert len(got) == 3 and len({r.contour for r in got}) == 1 and all(r.a.z == r.b.z == 0.5 for r in got)


def test_clusters_are_found():
    rng = np.random.default_rng(0)
    points = np.vstack([rng.normal(c, 0.1, (60, 3)) for c in (0, 3, 6)] + [rng.uniform(-3, 9, (12, 3))])
    got = clusters.density_clusters(points, 10, 100)
    assert [len(set(got[k * 60 : (k + 1) * 60]) - {-1}) for k in range(3)] == [1, 1, 1] and len(set(got) - {-1}) == 3


def _clustered(spark, clouds, least, most, size=256):
    rows = [(c, i, *map(float, p)) for c, points in clouds.items() for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "cloud_id string, idx long, x double, y double, z double")
    got = density.find_clusters(df, least=least, most=most, size=size).collect()
    assert len(got) == len(rows)
    return {c: np.array([r.cluster for r in sorted((r for r in got if r.cloud_id == c), key=lambda r: r.idx)]) for c in clouds}


@pytest.mark.parametrize("finish", [500_000, 100])
def test_clusters_of_several_clouds(spark, finish, monkeypatch):
    """As the array function finds them: 2,000 points on a coarse lattice (many ties, equal points), and a small cloud beside them; by rounds and in one task."""
    monkeypatch.setattr(density, "FINISH", finish)
    rng = np.random.default_rng(3)
    blobs = [rng.normal(rng.uniform(0, 10, 3), rng.uniform(0.05, 0.5), (rng.integers(60, 250), 3)) for _ in range(12)]
    cloud = np.vstack([*blobs, rng.uniform(-3, 13, (300, 3))])[:2000]
    clouds = {"fine": cloud[rng.permutation(len(cloud))[:700]], None: np.round(cloud * 2) / 2, "tiny": cloud[:1]}
    got = _clustered(spark, clouds, 1 / 100, 1 / 4)
    for c in ("fine", None):
        n = len(clouds[c])
        want = clusters.density_clusters(clouds[c], n // 100, n // 4)
        assert want.max() > 1 and (got[c] == want).all()
    assert got["tiny"].tolist() == [-1]


def test_clusters_of_odd_points(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, 0, nan, 0.0, 0.0), (1, 1, None, 0.0, 0.0), (1, 2, 0.0, inf, 0.0)] + [(1, i, 1.0, 1.0, 1.0) for i in range(3, 43)], "cloud_id int, idx int, x double, y double, z double")
    got = density.find_clusters(df, least=1 / 4, most=1.0).collect()
    assert len(got) == 43 and {r.cluster for r in got} == {-1}  # equal points are one whole, which is none
    assert density.find_clusters(df.limit(0)).count() == 0


def _torus(n, m):
    point = lambda i, j: ((3 + math.cos(2 * math.pi * j / m)) * math.cos(2 * math.pi * i / n), (3 + math.cos(2 * math.pi * j / m)) * math.sin(2 * math.pi * i / n), math.sin(2 * math.pi * j / m))
    verts = [point(i, j) for i in range(n) for j in range(m)]
    at = lambda i, j: (i % n) * m + j % m
    faces = [f for i in range(n) for j in range(m) for f in ((at(i, j), at(i + 1, j), at(i, j + 1)), (at(i + 1, j), at(i, j + 1), at(i + 1, j + 1)))]
    return verts, faces


def _sheet(n):
    verts = [(float(i), float(j), math.sin(i) + 0.1 * j) for i in range(n) for j in range(n)]
    faces = [f for i in range(n - 1) for j in range(n - 1) for f in ((i * n + j, (i + 1) * n + j, i * n + j + 1), ((i + 1) * n + j, i * n + j + 1, (i + 1) * n + j + 1))]
    return verts, faces


def _walked(verts, faces, normal, d):
    """Lines by walking from face to face: name -> (edges in order, faces, closed)."""
    above = [sum(a * b for a, b in zip(normal, v, strict=True)) >= d for v in verts]
    cut = {}
    for f, vs in enumerate(faces):
        e = [f"{min(a, b)}-{max(a, b)}" for a, b in itertools.combinations(vs, 2) if above[a] != above[b]]
        if e:
            cut[f] = e
    at = {}
    for f, e in cut.items():
        for x in e:
            at.setdefault(x, []).append(f)
    left, out = set(cut), {}
    starts = sorted((x, fs[0]) for x, fs in at.items() if len(fs) != 2) + sorted((x, min(fs)) for x, fs in at.items() if len(fs) == 2)
    for edge, f in starts:
        if f not in left:
            continue
        line, way, x = [edge], [], edge
        while f in left:
            left.remove(f)
            way.append(f)
            x = next(e for e in cut[f] if e != x)
            line.append(x)
            f = next((g for g in at[x] if g in left), None) if len(at[x]) == 2 else None
        out[f"{edge}/{way[0]}"] = (line[:-1] if x == edge else line, way, x == edge)
    return out


@pytest.mark.parametrize(("mesh", "normal", "d"), [(_torus(24, 12), (0.0, 0.0, 1.0), 0.3), (_torus(17, 9), (0.6, 0.0, 0.8), 0.1), (_sheet(9), (0.0, 0.0, 1.0), 0.4), (_torus(5, 4), (0.0, 1.0, 0.0), 9.0)])
def test_contours_in_order(spark, mesh, normal, d):
    verts, faces = mesh
    v = spark.createDataFrame([("m", i, *p) for i, p in enumerate(verts)], "mesh string, vid int, x double, y double, z double")
    f = spark.createDataFrame([("m", i, *p) for i, p in enumerate(faces)], "mesh string, fid int, v0 int, v1 int, v2 int")
    got = {}
    for r in meshes.contours(v, f, normal, d).collect():
        got.setdefault(r.contour, []).append(r)
    want = _walked(verts, faces, normal, d)
    assert set(got) == set(want)
    for name, (line, way, closed) in want.items():
        rows = sorted(got[name], key=lambda r: r.k)
        assert [r.k for r in rows] == list(range(len(line))) and [r.fid for r in rows] == way + [None] * (len(line) - len(way)) and all(r.closed == closed for r in rows)
        for r, e in zip(rows, line, strict=True):
            a, b = (np.array(verts[int(i)]) for i in e.split("-"))
            p = np.array([r.x, r.y, r.z])
            assert abs(np.dot(normal, p) - d) < 1e-9 and np.linalg.norm(np.cross(p - a, b - a)) < 1e-9


def test_components_with_negative_places(spark):
    mask = spark.createDataFrame([(0, 0, 0, 1.0), (0, -1, (1 << 20) - 4, 1.0), (-1, 0, 1, 1.0)], "x int, y int, z int, value double")
    got = {(r.x, r.y, r.z): r.component for r in components.label_mask(mask).collect()}
    assert len(set(got.values())) == 2 and got[0, 0, 0] == got[-1, 0, 1]
    far = spark.createDataFrame([(0, 0, 0, 1.0), (0, -1, (1 << 20) - 1, 1.0)], "x int, y int, z int, value double")
    with pytest.raises(ValueError, match="places at most"):
        components.label_mask(far)


def test_wide_density(spark):
    """Three passes give the cubic kernel's values."""
    p = spark.createDataFrame([(0, 0, 0), (0, 0, 0), (2, -1, 5)], "x int, y int, z int")
    got = {(r.x, r.y, r.z): r.value for r in voxels.density(p, 1.5).collect()}
    want = {}
    for at, n in (((0, 0, 0), 2), ((2, -1, 5), 1)):
        for i, j, k, w in G.gaussian_kernel(1.5):
            key = (at[0] + i, at[1] + j, at[2] + k)
            want[key] = want.get(key, 0) + n * w / 3
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want) and abs(sum(got.values()) - 1) < 1e-9


def test_enclosing_patch(spark):
    p = spark.createDataFrame([(float(i), float(i), 0.0) for i in range(10)], "x double, y double, z double")
    mean, axes, low, high = clusters.enclosing_patch(p)
    assert np.allclose(mean, (4.5, 4.5, 0)) and np.allclose(np.abs(axes[0]), (math.sqrt(0.5), math.sqrt(0.5), 0)) and np.allclose(low[1:], 0)


def test_feature_types(spark):
    types = features.feature_types(spark)
    assert [r.type for r in features.parse_type(types, "receptor profile").collect()] == ["ReceptorDensityProfile"]
    assert features.parse_type(types, "connectivity").count() == 5

    @features.live_query("Foo")
    def foo(spark, concepts, n=1):
        return concepts.withColumn("n", F.lit(n))

    assert features.run_live(spark, "Foo", types, n=3).first().n == 3 and features.run_live(spark, "Bar", types) is None


def test_specs(spark, tmp_path):
    base = {"@type": "parcellation", "@id": "p", "name": "P", "@version": {"name": "2", "@prev": "q"}, "regions": [{"name": "a", "rgb": "#010203", "children": [{"name": "a1"}, {"name": "a2"}]}, {"name": "b"}]}
    (tmp_path / "one").mkdir()
    (tmp_path / "two").mkdir()
    (tmp_path / "one/p.json").write_text(json.dumps(base))
    (tmp_path / "one/m.json").write_text(json.dumps({"@type": "map", "@id": "m", "indices": {"a": [{"volume": 1, "label": 4}], "b": [{"label": 2}, {"fragment": "left"}]}}))
    (tmp_path / "two/p.json").write_text(json.dumps(base | {"name": "Q"}))
    rows = specs.read_specs(spark, str(tmp_path / "one"), str(tmp_path / "two"))
    assert specs.build(rows, "parcellation").first().name == "Q"
    assert {(r.region, r.volume, r.label, r.fragment) for r in specs.build(rows, "map").collect()} == {("a", 1, 4, None), ("b", 0, 2, None), ("b", 0, None, "left")}
    assert {(r.name, r.parent) for r in specs.regions(rows).collect()} == {("a", None), ("b", None), ("a1", "a"), ("a2", "a")}


def test_images_and_archives(spark, tmp_path):
    data = np.zeros((3, 4, 5))
    data[1, 2, 3], data[0, 0, 4] = 7, 2.5
    affine = np.array([[2.0, 0, 0, -1], [0, 2, 0, 0], [0, 0, 2, 5], [0, 0, 0, 1]])
    raw = files.write_nifti(data, affine)
    back, m = files.read_nifti(raw)
    assert np.array_equal(back, data) and np.allclose(m, affine)
    (tmp_path / "a.nii").write_bytes(raw)
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/a.nii", raw)
        z.writestr("in/readme.txt", "hello")
    direct = files.reader_of("a.nii")(spark, str(tmp_path / "a.nii"))
    inside = files.voxels(files.only_member(files.binary(spark, str(tmp_path), ".zip"), ".nii"))
    for v in (direct, inside):
        assert {(r.x, r.y, r.z, r.t, r.value) for r in v.collect()} == {(1, 2, 3, 0, 7.0), (0, 0, 4, 0, 2.5)}
    with pytest.raises(Exception, match="end with"):
        files.only_member(files.binary(spark, str(tmp_path), ".zip"), ".csv").collect()
    assert files.search(spark, str(tmp_path), ".zip").count() == 1


def test_tables(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx\n\t\n2\ty\n")
    assert files.reader_of("t.tsv")(spark, str(tmp_path / "t.tsv")).count() == 2
    (tmp_path / "cells.txt").write_text("# x y layer label\n1.5 2.5 3 7\n2 3 4 8\n")
    assert [tuple(r) for r in files.cells(spark, str(tmp_path / "cells.txt")).drop("path").orderBy("x").collect()] == [(1.5, 2.5, 3, 7), (2.0, 3.0, 4, 8)]
    (tmp_path / "probs.txt").write_text("0 0.5 2 0.25\n1 1.0\n")
    coords = spark.createDataFrame([(0, 1, 2, 3), (1, 4, 5, 6)], "id long, x int, y int, z int")
    assert files.sparse_text(spark, str(tmp_path / "probs.txt"), coords).count() == 3
    raw = sinks.archive("A", "about", {"t": coords})
    assert sorted(zipfile.ZipFile(__import__("io").BytesIO(raw)).namelist()) == ["README.md", "t.csv"]


def test_sparse_text_in_several_splits(spark, tmp_path):
    """Lines keep their numbers over splits and files."""
    lines = [f"{i % 5} {i}.5" + (f" 7 {i}.25" if i % 3 else "") for i in range(900)]
    lines[10] = lines[500] = ""
    (tmp_path / "m").mkdir()
    for k, (a, b) in enumerate([(0, 700), (700, 710), (710, 900)]):
        (tmp_path / f"m/{k}.txt").write_text("\n".join(lines[a:b]) + "\n")
    coords = spark.createDataFrame([(i, i, i + 1, i + 2) for i in range(900)], "id long, x int, y int, z int")
    want = sorted((int(v), float(p), i, i + 1, i + 2) for i, line in enumerate(lines) for v, p in zip(line.split()[::2], line.split()[1::2], strict=True))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    try:
        assert spark.read.text(str(tmp_path / "m")).rdd.getNumPartitions() > 5
        assert sorted(tuple(r) for r in files.sparse_text(spark, str(tmp_path / "m"), coords).collect()) == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_result_does_not_depend_on_partitions(spark, sf):
    from stratlas.plans.catalogue import QUERIES

    want = sorted(map(str, QUERIES["compare_regions_with_parts"](spark, sf).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted(map(str, QUERIES["compare_regions_with_parts"](spark, sf).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_atlas_facade(spark):
    from stratlas.plans.atlas import Atlas

    regions = spark.createDataFrame([(i, p, n, i.upper(), "p1") for i, p, n in TREE], "id string, parent string, name string, key string, parcellation_id string")
    maps = spark.createDataFrame([(0, "m", "s", "p1", "STATISTICAL")], "ord int, id string, space_id string, parcellation_id string, maptype string")
    index = spark.createDataFrame([("m", "Area hOc1", 0, None, None), ("m", "Area 4p", 1, None, None)], "map_id string, region string, volume int, fragment string, label double")
    v = blob(spark, [(1, 1, 1, 0.5)]).union(spark.createDataFrame([("m", 1, None, 1, 1, 1, 0.25), ("m", 1, None, 2, 1, 1, 0.75)], "map_id string, volume int, fragment string, x int, y int, z int, value double"))
    atlas = Atlas(regions, maps, index, v)
    assert [r.id for r in atlas.find_regions("hoc1").collect()] == ["a1"]
    assert atlas.get_regions(spark.createDataFrame([("4p",)], "spec string"), "p1").first().id == "b1"
    assert atlas.get_map(space="s").first().id == "m" and atlas.get_map(space="t").isEmpty()
    assert atlas.region_voxels("a").count() == 1 and atlas.region_voxels("r").count() == 2
    grid = [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0], [0, 0, 0, 1]]
    p = spark.createDataFrame([(7, 1.0, 1.0, 1.0)], "idx int, x double, y double, z double")
    assert {(r.region, r.map_value) for r in atlas.assign(p, grid).collect()} == {("Area hOc1", 0.5), ("Area 4p", 0.25)}
    assert atlas.assign(p, grid, sigma_voxels=1.0).count() == 2


def test_surfaces(spark, tmp_path):
    import base64
    import struct
    import zlib

    from stratlas.sources import surfaces

    def array(intent, kind, data, packed=True):
        raw = base64.b64encode(zlib.compress(data.tobytes())).decode() if packed else " ".join(map(str, data.ravel()))
        dims = " ".join(f'Dim{i}="{n}"' for i, n in enumerate(data.shape))
        return f'<DataArray Intent="NIFTI_INTENT_{intent}" DataType="NIFTI_TYPE_{kind}" Encoding="{"GZipBase64Binary" if packed else "ASCII"}" Endian="LittleEndian" Dimensionality="{data.ndim}" {dims}><Data>{raw}</Data></DataArray>'

    verts, tri, lab = np.eye(3, dtype="<f4"), np.array([[0, 1, 2]], dtype="<i4"), np.array([4, 0, 4], dtype="<i4")
    (tmp_path / "s.gii").write_text(f"<GIFTI>{array('POINTSET', 'FLOAT32', verts)}{array('TRIANGLE', 'INT32', tri)}{array('LABEL', 'INT32', lab, False)}</GIFTI>")
    f = files.binary(spark, str(tmp_path), ".gii")
    assert [(r.vid, r.x, r.y, r.z) for r in surfaces.vertices(f).collect()] == [(0, 1, 0, 0), (1, 0, 1, 0), (2, 0, 0, 1)]
    assert [(r.v0, r.v1, r.v2) for r in surfaces.faces(f).collect()] == [(0, 1, 2)] and [r.label for r in surfaces.labels(f).collect()] == [4, 0, 4]

    word = lambda s: struct.pack(">i", len(s) + 1) + s.encode() + b"\0"
    table = [("unknown", 1, 1, 1), ("area", 10, 20, 30)]
    body = struct.pack(">i", 3) + struct.pack(">6i", 0, 10 + (20 << 8) + (30 << 16), 1, 0, 2, 1 + (1 << 8) + (1 << 16))
    body += struct.pack(">iii", 1, -2, 2) + word("table") + struct.pack(">i", 2)
    for i, (name, *rgb) in enumerate(table):
        body += struct.pack(">i", i) + word(name) + struct.pack(">4i", *rgb, 0)
    (tmp_path / "a.annot").write_bytes(body)
    got = surfaces.annotation(files.binary(spark, str(tmp_path), ".annot"))
    assert [(r.label, r.name) for r in got.orderBy("vid").collect()] == [(1, "area"), (-1, None), (0, "unknown")]
    assert [r.label for r in meshes.clear_background(got).orderBy("vid").collect()] == [1, 0, 0]

    head = b"mrtrix tracks\ndatatype: Float32LE\nfile: . 60\nEND\n"
    data = np.array([[1, 2, 3], [4, 5, 6], [np.nan] * 3, [7, 8, 9], [np.nan] * 3, [np.inf] * 3], dtype="<f4")
    (tmp_path / "t.tck").write_bytes(head.ljust(60, b"\0") + data.tobytes())
    assert [(r.track, r.idx, r.x) for r in surfaces.tracks(files.binary(spark, str(tmp_path), ".tck")).collect()] == [(0, 0, 1), (0, 1, 4), (1, 0, 7)]


def test_map_indices(spark):
    index = spark.createDataFrame([("m", "a1", 0, 1, None), ("m", "a2", 0, 2, None), ("m", "b", 1, None, "left")], "map_id string, region string, volume int, label int, fragment string")
    assert registry.region_of(index, "m", 0, 2).first().region == "a2" and registry.region_of(index, "m", 1, None, "left").first().region == "b"
    below = spark.createDataFrame([("a", "a"), ("a", "a1"), ("a", "a2"), ("b", "b"), ("a1", "a1")], "ancestor string, region string")
    found = registry.indices_of(index, below)
    assert {(r.ancestor, r.label) for r in found.collect()} == {("a", 1), ("a", 2), ("b", None), ("a1", 1)}
    assert registry.unique_index(found.filter("ancestor <> 'a'")).count() == 2
    with pytest.raises(Exception, match="has 2 indices"):
        registry.unique_index(found).collect()


def test_faulty_profiles(spark):
    p = spark.createDataFrame([(f, d) for f, ds in ((1, (0.0, 0.5)), (2, (0.0, 0.0)), (3, (0.1, 1.2))) for d in ds], "feature_id int, depth double")
    b = spark.createDataFrame([(f, k, k / 7) for f in (1, 4) for k in range(7 if f == 1 else 5)], "feature_id int, layer int, depth double")
    assert {r.feature_id for r in tabular.faulty_profiles(p, b).collect()} == {2, 3, 4}


def _boxes(spark, r, n):
    rows = []
    for i in range(n):
        side = r.choice((0.0, 0.3, 1.0, 7.0))
        low = [r.uniform(-20, 20) for _ in range(3)]
        rows.append((i, *low, *[v + side * r.random() for v in low]))
    rows.append((n, *[-100.0] * 3, *[100.0] * 3))
    return rows, spark.createDataFrame(rows, "id int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")


def test_boxes_of_all_sizes(spark):
    """Boxes from points to one around everything, against all pairs."""
    r = random.Random(4)
    (a, left), (b, right) = _boxes(spark, r, 150), _boxes(spark, r, 150)
    meet = lambda p, q: all(max(p[1 + i], q[1 + i]) < min(p[4 + i], q[4 + i]) for i in range(3))
    got = locations.intersect_boxes(left.withColumnRenamed("id", "a"), right.withColumnRenamed("id", "b"), "a", "b").collect()
    assert sorted((x.a, x.b) for x in got) == sorted((p[0], q[0]) for p in a for q in b if meet(p, q))
    points = [(i, *[r.uniform(-20, 20) for _ in range(3)]) for i in range(300)] + [(900 + p[0], *p[1:4]) for p in a[:20]]
    held = locations.points_in_boxes(spark.createDataFrame(points, "idx int, x double, y double, z double"), left).select("idx", "id").collect()
    want = [(p[0], q[0]) for p in points for q in a if all(q[1 + i] <= p[1 + i] <= q[4 + i] for i in range(3))]
    assert sorted(map(tuple, held)) == sorted(want)


def test_small_boxes_do_not_share_the_cells_of_a_large_one(spark):
    rows, boxes = _boxes(spark, random.Random(1), 2000)
    lowest = locations._lowest(boxes)
    cells = locations._box_cells(boxes.withColumn("level", locations._own_level(lowest))).groupBy("level", "c0", "c1", "c2").count()
    assert cells.agg({"count": "max"}).first()[0] < 100 and len(locations._levels(lowest, boxes)) <= locations.LEVELS + 1


def test_nearest_without_coordinates(spark):
    xyz = "x double, y double, z double"
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, None, 0.0, 0.0), (3, float("nan"), 0.0, 0.0), (4, 1e6, 0.0, 0.0), (5, float("inf"), 0.0, 0.0)], f"id int, {xyz}")
    targets = spark.createDataFrame([(10, 0.5, 0.0, 0.0), (11, None, None, None), (12, float("nan"), 0.0, 0.0), (13, 2.0, 0.0, 0.0)], f"t int, {xyz}")
    assert {(r.id, r.t) for r in locations.nearest(points, targets, "id", "t", 0.1).collect()} == {(1, 10), (4, 13)}
    assert locations.nearest(points.filter("id in (2, 3)"), targets, "id", "t", 0.1).count() == 0


def test_regions_nested_deeply(spark):
    spec = {"name": "r16"}
    for i in range(15, -1, -1):
        spec = {"name": f"r{i}", "children": [spec]}
    rows = spark.createDataFrame([("f", "parcellation", json.dumps({"@id": "p", "regions": [spec]}))], "filename string, type string, spec string")
    assert {(r.name, r.parent) for r in specs.regions(rows).collect()} == {("r0", None)} | {(f"r{i + 1}", f"r{i}") for i in range(16)}


def test_mask_sources(spark):
    tree = hierarchy.with_paths(spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "b"), ("e", "a"), ("f", "e")], "id string, parent string"))
    got = hierarchy.mask_sources(tree, spark.createDataFrame([("b",), ("c",), ("f",)], "id string"))
    assert {tuple(r) for r in got.collect()} == {("a", "b"), ("a", "f"), ("b", "b"), ("c", "c"), ("e", "f"), ("f", "f")}


def test_chunked_volume(spark, tmp_path):
    """A mosaic of chunks of which some are missing, cut to a box, at the scale a wish and a byte cap give."""
    rng = np.random.default_rng(0)
    whole = (rng.random((50, 40, 30)) < 0.1) * rng.integers(1, 9, (50, 40, 30)).astype("u2")
    scales = [{"key": f"s{k}", "resolution": [2e5 * 2**k] * 3, "size": [50 >> k, 40 >> k, 30 >> k], "encoding": "raw"} for k in range(3)]
    (tmp_path / "info").write_text(json.dumps({"data_type": "uint16", "scales": scales}))
    (tmp_path / "s0").mkdir()
    for x in range(0, 50, 16):
        for y in range(0, 40, 16):
            for z in range(0, 30, 16):
                ends = [min(a + 16, n) for a, n in zip((x, y, z), whole.shape, strict=True)]
                part = whole[x : ends[0], y : ends[1], z : ends[2]]
                if (x, y, z) == (16, 16, 0):
                    whole[x : ends[0], y : ends[1], z : ends[2]] = 0
                    continue
                raw = part.astype("<u2").tobytes(order="F")
                (tmp_path / "s0" / "_".join(f"{a}-{b}" for a, b in zip((x, y, z), ends, strict=True))).write_bytes(gzip.compress(raw) if x else raw)
    found = chunks.read_info(spark, str(tmp_path))
    assert [chunks.select_scale(found, r, m).key for r, m in ((None, 1 << 30), (0.5, 1 << 30), (0.1 * 8, 1 << 30), (None, 100_000), (0.2, 3_000))] == ["s0", "s1", "s2", "s1", "s2"]
    with pytest.raises(ValueError):
        chunks.select_scale(found, 0.01)
    low, high = (10, 5, 3), (40, 33, 20)
    got = {(r.x, r.y, r.z, r.value) for r in chunks.read_voxels(spark, str(tmp_path), found[0], (low, high)).collect()}
    box = whole[low[0] : high[0], low[1] : high[1], low[2] : high[2]]
    assert got == {(int(x) + 10, int(y) + 5, int(z) + 3, float(box[x, y, z])) for x, y, z in np.argwhere(box)}
    assert chunks.read_voxels(spark, str(tmp_path), found[0]).count() == int((whole > 0).sum())
    opened = chunks.read_voxels(spark, str(tmp_path), found[0], ((0, 0, 0), (5, 5, 5)))
    assert opened.count() == int((whole[:5, :5, :5] > 0).sum())


def test_sqlite_table(spark, tmp_path):
    with sqlite3.connect(tmp_path / "a.db") as db:
        db.execute("CREATE TABLE bids (subject TEXT, session INTEGER, path TEXT)")
        db.executemany("INSERT INTO bids VALUES (?, ?, ?)", [(f"s{i}", i % 3, None) for i in range(500)])
    db.close()
    got = files.sqlite(files.binary(spark, str(tmp_path), ".db"), "bids", "subject string, session long").collect()
    assert sorted(map(tuple, got)) == sorted((f"s{i}", i % 3) for i in range(500))


def test_repositories_by_type(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.txt").write_text("x")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("b/c.txt", "y")
    got = files.files_of(spark, {"@type": "repository/v1.0.0/localfolder", "folder": str(tmp_path / "r")}).collect()
    assert [bytes(r.content) for r in got] == [b"x"]
    got = files.files_of(spark, {"@type": "repository/zippedfile", "url": str(tmp_path / "z.zip")}).collect()
    assert [(r.path, bytes(r.content)) for r in got] == [("b/c.txt", b"y")]
    with pytest.raises(ValueError):
        files.files_of(spark, {"@type": "repository/other"})


def test_affines(spark, tmp_path):
    m = np.array([[2.0, 0, 0, 5], [0, 3, 0, 6], [0, 0, 4, 7], [0, 0, 0, 1]])
    (tmp_path / "a.nii").write_bytes(files.write_nifti(np.ones((2, 2, 2)), m))
    assert np.allclose(files.affines(files.binary(spark, str(tmp_path), ".nii")).first().affine, m.ravel())
