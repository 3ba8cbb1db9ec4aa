"""Patches of the points' planes and the image under them, regions assigned to regions, volumes at several scales."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratlas.operators import assignment, patches, polygons, voxels
from stratlas.plans.registry import query
from stratlas.plans.spatial import CLOUD, DISTANCE, GRID, NORMAL, TO_MM, cloud, grid
from stratlas.plans.stored import _folder
from stratlas.sources import pyramids

_CORNERS = [f"c{k}_{c}" for k in range(4) for c in "xyz"]


def _spread(df, *keys):
    return df.select(*keys, *[(F.round(f"c{k}.{c}", 6) + F.lit(0.0)).alias(f"c{k}_{c}") for k in range(4) for c in "xyz"])


@query(f"""
WITH {GRID}, b AS (SELECT volume, min(x) AS x, min(y) AS y, min(z) AS z, max(x) + 1 - min(x) AS sx, max(y) + 1 - min(y) AS sy, max(z) + 1 - min(z) AS sz FROM grid GROUP BY volume),
f AS (SELECT *, CASE WHEN sx <= sy AND sx <= sz THEN 0 WHEN sy <= sz THEN 1 ELSE 2 END AS flat FROM b)
SELECT volume, CASE flat WHEN 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS nx, CASE flat WHEN 1 THEN -1.0 ELSE 0.0 END::DOUBLE AS ny, CASE flat WHEN 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS nz,
  round(CASE flat WHEN 0 THEN x / 8.0 - 1 WHEN 1 THEN 1 - y / 8.0 ELSE z / 8.0 - 1 END, 9)::DOUBLE AS d FROM f
""")
def image_planes(spark, sf_dir):
    """The plane of each label's volume, cut to its own box."""
    b = voxels.bounding_box(grid(spark, sf_dir), "volume")
    number = lambda v: F.lit(float(v))
    affine = [c for r, axis in enumerate("xyz") for c in (*[number(0.125 if r == k else 0) for k in range(3)], F.col(axis + "0") / 8 - 1)]
    images = b.select("volume", F.array(*affine).alias("affine"), *[(F.col(c + "1") - F.col(c + "0")).alias("s" + c) for c in "xyz"])
    return patches.image_planes(images).select("volume", *[(F.round(c, 9) + F.lit(0.0)).alias(c) for c in patches.PLANE])


def _signed(v: str) -> str:
    sign = f"CASE WHEN abs({v}x) > 1e-9 THEN sign({v}x) WHEN abs({v}y) > 1e-9 THEN sign({v}y) ELSE sign({v}z) END"
    return ", ".join(f"{sign} * {v}{c} AS {v[1:]}{c}" for c in "xyz")


def _patches_sql(points: str, e1: tuple[float, float, float], e2: tuple[float, float, float], margin: tuple[float, float]) -> str:
    """Patches of ``points`` (label, x, y, z: feet in a plane that e1 and e2 span)."""
    dot = lambda e: " + ".join(f"{w} * {c}" for w, c in zip(e, "xyz", strict=True))
    mix = lambda s, v: ", ".join(f"{s.format(a=a, b=b)} AS _{v}{c}" for a, b, c in zip(e1, e2, "xyz", strict=True))
    ends = ", ".join(f"arg_min({{'x': x, 'y': y, 'z': z}}, {s} * (x * {v}x + y * {v}y + z * {v}z)) AS p{k}" for k, (v, s) in enumerate((("v1", 1), ("v1", -1), ("v2", 1), ("v2", -1))))
    corner = lambda p, up, out: [f"{p}.{c} + {up} * w * v2{c} + {out} * {margin[0]} * v1{c}" for c in "xyz"]
    made = [x for p, up, out in (("p1", 1, 1), ("p0", 1, -1), ("p0", -1, -1), ("p1", -1, 1)) for x in corner(p, up, out)]
    return f"""{points}, st AS (SELECT *, {dot(e1)} AS s, {dot(e2)} AS t FROM feet), mo AS (SELECT label, atan2(2 * covar_pop(s, t), var_pop(s) - var_pop(t)) / 2 AS turn FROM st GROUP BY label),
ax AS (SELECT label, {mix("cos(turn) * {a} + sin(turn) * {b}", "v1")}, {mix("cos(turn) * {b} - sin(turn) * {a}", "v2")} FROM mo), ay AS (SELECT label, {_signed("_v1")}, {_signed("_v2")} FROM ax),
en AS (SELECT label, count(*) AS points, {", ".join(f"any_value({v}{c}) AS {v}{c}" for v in ("v1", "v2") for c in "xyz")}, {ends} FROM st JOIN ay USING (label) GROUP BY label),
wi AS (SELECT *, sqrt((p3.x - p2.x) ** 2 + (p3.y - p2.y) ** 2 + (p3.z - p2.z) ** 2) / 2 + {margin[1]} AS w FROM en),
patches AS (SELECT label, points, {", ".join(f"{x} AS {n}" for x, n in zip(made, _CORNERS, strict=True))} FROM wi)"""


_TILTED = _patches_sql(f"{CLOUD}, feet AS (SELECT label, x - (0.6 * x + 0.8 * z - 0.02) * 0.6 AS x, y, z - (0.6 * x + 0.8 * z - 0.02) * 0.8 AS z FROM cloud)", (0.8, 0.0, -0.6), (0.0, 1.0, 0.0), (0.5, 0.25))


def _tilted(spark, sf_dir):
    p = cloud(spark, sf_dir).withColumns(dict(zip(patches.PLANE, map(F.lit, (*NORMAL, DISTANCE)), strict=True)))
    return patches.enclosing_patches(p, ["label"], (0.5, 0.25))


@query(f"WITH {_TILTED} SELECT label, points, false AS axis_aligned, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _CORNERS)} FROM patches")
def enclosing_patches(spark, sf_dir):
    """Around each label's points in a tilted plane."""
    return _spread(_tilted(spark, sf_dir), "label", "points", "axis_aligned")


@query(f"WITH {_TILTED} SELECT label, {', '.join(f'round(c{(k + 2) % 4}_{c}, 6) + 0.0 AS c{k}_{c}' for k in range(4) for c in 'xyz')} FROM patches")
def flipped_patches(spark, sf_dir):
    return _spread(patches.flip(_tilted(spark, sf_dir)), "label")


_LEVEL = _patches_sql(f"{GRID}, level AS (SELECT label, avg(y) AS h FROM cloud GROUP BY label), feet AS (SELECT label, x, h AS y, z FROM cloud JOIN level USING (label))", (0.0, 0.0, 1.0), (-1.0, 0.0, 0.0), (0.25, 0.125))


@query(f"""
WITH {_LEVEL}, ce AS (SELECT *, (c0_x + c1_x + c2_x + c3_x) / 4 AS cx, (c0_y + c1_y + c2_y + c3_y) / 4 AS cy, (c0_z + c1_z + c2_z + c3_z) / 4 AS cz, sqrt((c0_x - c1_x) ** 2 + (c0_z - c1_z) ** 2) AS len FROM patches),
fr AS (SELECT *, (c0_x - c1_x) / len AS ux, (c0_z - c1_z) / len AS uz, floor((least(c0_x, c1_x, c2_x, c3_x) + 1) / 0.125) AS bx, floor((least(c0_z, c1_z, c2_z, c3_z) + 1) / 0.125) AS bz FROM ce),
ti AS (SELECT *, [{", ".join(f"trunc((cx + ux * (c{k}_x - cx) + uz * (c{k}_z - cz) + 1) / 0.125 - bx)" for k in range(4))}] AS tx, [{", ".join(f"trunc((cz - uz * (c{k}_x - cx) + ux * (c{k}_z - cz) + 1) / 0.125 - bz)" for k in range(4))}] AS tz FROM fr),
px AS (SELECT label, i, unnest(range(CAST(list_max(tz) - list_min(tz) - 2 AS INTEGER))) AS k, * EXCLUDE (label, i) FROM (SELECT *, unnest(range(CAST(list_max(tx) - list_min(tx) - 2 AS INTEGER))) AS i FROM ti)),
mm AS (SELECT *, 0.125 * (bx + list_min(tx) + 1 + i) - 1 - cx AS dx, 0.125 * (bz + list_min(tz) + 1 + k) - 1 - cz AS dz FROM px),
qq AS (SELECT label, i, k, (cx + ux * dx - uz * dz + 1) * 8 AS qx, (cy + 1) * 8 AS qy, (cz + uz * dx + ux * dz + 1) * 8 AS qz FROM mm),
al AS (SELECT x, y, z, sum(value) AS value FROM grid GROUP BY ALL),
co AS (SELECT label, i, k, floor(qx) + a AS x, floor(qy) + b AS y, floor(qz) + c AS z, abs(1 - a - (qx - floor(qx))) * abs(1 - b - (qy - floor(qy))) * abs(1 - c - (qz - floor(qz))) AS w FROM qq, range(2) s(a), range(2) t(b), range(2) u(c))
SELECT label, CAST(i AS INTEGER) AS i, CAST(k AS INTEGER) AS k, round(sum(w * value), 6) AS value FROM co JOIN al USING (x, y, z) WHERE w > 0 GROUP BY label, i, k HAVING sum(w * value) <> 0
""")
def patch_pixels(spark, sf_dir):
    """All points' density under a patch around each label's points, at their mean height."""
    c = cloud(spark, sf_dir)
    level = c.groupBy("label").agg(F.avg("y").alias("d")).withColumns({"nx": F.lit(0.0), "ny": F.lit(1.0), "nz": F.lit(0.0)})
    p = patches.enclosing_patches(c.join(level, "label"), ["label"], (0.25, 0.125))
    image = grid(spark, sf_dir).groupBy("x", "y", "z").agg(F.sum("value").alias("value"))
    return patches.extract(p, image, TO_MM, "label").select("label", "i", "k", F.round("value", 6).alias("value"))


@query()
def surface_patches(spark, sf_dir):
    """Patches along a surface of consecutive points in six layers, in sections at the labels' mean heights, weighted by the points' density."""
    c = cloud(spark, sf_dir)
    layers = c.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(6)))).select(
        F.when(F.col("label") < 5, "left").otherwise("right").alias("mesh"), F.col("k").cast("string").alias("layer"), F.col("idx").alias("vid"),
        (F.col("x") * (1 + (F.col("k") - 4) / 10)).alias("x"), "y", (F.col("z") * (1 + (F.col("k") - 4) * F.col("k") / 100)).alias("z"))
    after = c.select((F.col("idx") - 1).alias("v0"), F.col("label").alias("l1")).join(c.select((F.col("idx") - 2).alias("v0"), F.col("label").alias("l2")), "v0")
    side = lambda name: F.col(name) < 5
    faces = c.withColumnRenamed("idx", "v0").join(after, "v0").filter((side("label") == side("l1")) & (side("label") == side("l2")))
    faces = faces.select(F.when(side("label"), "left").otherwise("right").alias("mesh"), "v0", (F.col("v0") + 1).alias("v1"), (F.col("v0") + 2).alias("v2"))
    number = lambda v: F.lit(float(v))
    low = F.col("h") - 0.0625
    sections = c.groupBy(F.col("label").alias("section")).agg(F.avg("y").alias("h")).select(
        "section", F.array(*map(number, (0.125, 0, 0, -1)), *map(number, (0, 0.125, 0)), F.col("h"), *map(number, (0, 0, 0.125, -1))).alias("affine"), F.lit(16).alias("sx"), F.lit(1).alias("sy"), F.lit(16).alias("sz"),
        number(-1).alias("x0"), low.alias("y0"), number(-1).alias("z0"), number(1).alias("x1"), (low + 0.125).alias("y1"), number(1).alias("z1"))
    image = grid(spark, sf_dir).groupBy("x", "y", "z").agg(F.sum("value").alias("value"))
    got = patches.surface_patches(sections, layers, faces, "4", image, TO_MM, 2.0, (0.125, 0.125), 0.1)
    return _spread(got, "section", "mesh", "vid", "relevance", *[F.round(c, 6).alias(c) for c in "xyz"])


_IN = lambda p, q: " AND ".join(f"{p}.{c}0 >= {q}.{c}0 AND {p}.{c}1 <= {q}.{c}1" for c in "xyz")
_ENDS = ", ".join(f"min({c}) AS {c}0, max({c}) + 1 AS {c}1" for c in "xyz")


@query(f"""
WITH {GRID}, a AS (SELECT volume AS region, x, y, z FROM grid), b AS (SELECT volume AS other, x, y, z FROM grid WHERE value > 1 AND volume < 8),
na AS (SELECT region, count(*) AS na FROM a GROUP BY 1), nb AS (SELECT other, count(*) AS nb FROM b GROUP BY 1), s AS (SELECT region, other, count(*) AS shared FROM a JOIN b USING (x, y, z) GROUP BY ALL),
ba AS (SELECT region, {_ENDS} FROM a GROUP BY 1), bb AS (SELECT volume AS other, {_ENDS} FROM grid WHERE value > 1 AND volume >= 8 GROUP BY 1)
SELECT region, other, CASE WHEN shared = na AND shared = nb THEN 'EXACT' WHEN shared = na THEN 'CONTAINED' WHEN shared = nb THEN 'CONTAINS' ELSE 'OVERLAPS' END AS qualification, shared, 'mask' AS by FROM s JOIN na USING (region) JOIN nb USING (other)
UNION ALL SELECT region, other, CASE WHEN {_IN('ba', 'bb')} AND {_IN('bb', 'ba')} THEN 'EXACT' WHEN {_IN('ba', 'bb')} THEN 'CONTAINED' WHEN {_IN('bb', 'ba')} THEN 'CONTAINS' ELSE 'OVERLAPS' END, NULL, 'box'
FROM ba JOIN bb ON {" AND ".join(f"greatest(ba.{c}0, bb.{c}0) < least(ba.{c}1, bb.{c}1)" for c in "xyz")}
""")
def assign_regions(spark, sf_dir):
    """Each label's volume to the labels' cores (voxels of several points); labels from 8 on have only their core's box."""
    g = grid(spark, sf_dir)
    core = g.filter("value > 1").withColumnRenamed("volume", "other")
    boxes = voxels.bounding_box(core.filter("other >= 8"), "other")
    return assignment.assign_regions(g.withColumnRenamed("volume", "region"), core.filter("other < 8"), "region", "other", b_boxes=boxes)


_ALL = f"{GRID}, al AS (SELECT x, y, z, sum(value) AS value, max(volume) + 1.0 AS label FROM grid GROUP BY ALL)"


def _stored(spark, sf_dir, labels):
    value = F.max("volume") + 1 if labels else F.sum("value")
    folder = _folder(spark)
    pyramids.write_pyramid(grid(spark, sf_dir).groupBy("x", "y", "z").agg(value.alias("value")), folder, 0.125, (17, 17, 17), 4, labels, 4)
    return folder


def _every_scale(spark, sf_dir, labels):
    folder, out = _stored(spark, sf_dir, labels), None
    for k in range(4):
        scale, at = pyramids.read_pyramid(spark, folder, 0.125 * 2**k)
        at = at.select(F.lit(scale.scale).alias("scale"), "x", "y", "z", F.round("value", 9).alias("value"))
        out = at if out is None else out.union(at)
    return out


@query(f"WITH {_ALL} SELECT k AS scale, " + ", ".join(f"CAST({c} // (1 << k) AS INTEGER) AS {c}" for c in "xyz") + ", round(sum(value / (1 << (3 * k))), 9) AS value FROM al, (VALUES (0), (1), (2), (3)) s(k) GROUP BY ALL")
def value_pyramid(spark, sf_dir):
    """All points' density at four scales."""
    return _every_scale(spark, sf_dir, False)


@query(f"WITH {_ALL} SELECT k AS scale, " + ", ".join(f"CAST({c} // (1 << k) AS INTEGER) AS {c}" for c in "xyz") + ", CAST(label AS DOUBLE) AS value FROM al, (VALUES (0), (1), (2), (3)) s(k) WHERE " + " AND ".join(f"{c} % (1 << k) = 0" for c in "xyz"))
def label_pyramid(spark, sf_dir):
    """The largest label of each voxel at four scales."""
    return _every_scale(spark, sf_dir, True)


@query(f"WITH {_ALL} SELECT 0.25::DOUBLE AS resolution_mm, " + ", ".join(f"CAST({c} // 2 AS INTEGER) AS {c}" for c in "xyz") + ", round(sum(value) / 8, 9) AS value FROM al WHERE x // 2 BETWEEN 2 AND 5 AND y // 2 BETWEEN 3 AND 4 AND z // 2 BETWEEN 0 AND 6 GROUP BY ALL")
def pyramid_box(spark, sf_dir):
    """A box of the density at the coarsest scale that resolves 0.3 mm."""
    scale, at = pyramids.read_pyramid(spark, _stored(spark, sf_dir, False), 0.3, ((0.6, 0.75, -0.1), (1.4, 1.25, 1.7)))
    return at.select(F.lit(scale.resolution_mm).alias("resolution_mm"), "x", "y", "z", F.round("value", 9).alias("value"))


@query(f"""
WITH {CLOUD}, v AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY idx) AS k, count(*) OVER (PARTITION BY label) AS n, floor(x * 80 + 80) / 4 AS x, floor(z * 80 + 80) / 4 AS y FROM cloud),
e AS (SELECT a.label, a.x, a.y, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON a.label = b.label AND b.k = a.k % a.n + 1),
t AS (SELECT DISTINCT label, p.x AS px, q.y AS py, bool_or(abs((x2 - e.x) * (q.y - e.y) - (y2 - e.y) * (p.x - e.x)) < 1e-9 AND p.x BETWEEN least(e.x, x2) AND greatest(e.x, x2) AND q.y BETWEEN least(e.y, y2) AND greatest(e.y, y2)) AS edge,
  count(*) FILTER (WHERE (e.y <= q.y) <> (y2 <= q.y) AND p.x < e.x + (q.y - e.y) * (x2 - e.x) / (y2 - e.y)) % 2 = 1 AS inside FROM e, range(0, 41) p(x), range(0, 41) q(y) GROUP BY ALL)
SELECT label AS polygon, CAST(px AS INTEGER) AS x, CAST(py AS INTEGER) AS y FROM t WHERE edge OR inside
""")
def polygon_rasters(spark, sf_dir):
    """The polygon of each label's points in their order, in quarters of a pixel."""
    quarter = lambda c: (F.floor(F.col(c) * 80 + 80) / 4)
    c = cloud(spark, sf_dir)
    k = F.row_number().over(Window.partitionBy("label").orderBy("idx")) - 1
    return polygons.raster(c.select(F.col("label").alias("polygon"), F.lit(0).alias("ring"), k.alias("k"), quarter("x").alias("x"), quarter("z").alias("y")))
