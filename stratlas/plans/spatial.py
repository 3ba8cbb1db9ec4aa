"""Points, boxes, voxels and meshes; the first three dimensions of ``embeddings`` stand for coordinates.

A point's region is its label.  The voxel grid has eighths of a unit; its value
is the number of points of one label in a voxel, a statistical map per label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratlas.functions import geometry as G
from stratlas.operators import assignment, components, density, locations, meshes, similarity, voxels
from stratlas.plans.registry import query, table

TO_VOXEL = [[8, 0, 0, 8], [0, 8, 0, 8], [0, 0, 8, 8], [0, 0, 0, 1]]
TO_MM = [[0.125, 0, 0, -1], [0, 0.125, 0, -1], [0, 0, 0.125, -1], [0, 0, 0, 1]]
NORMAL, DISTANCE = (0.6, 0.0, 0.8), 0.02
ROTATED = [[0.0, -1.0, 0.0, 0.5], [1.0, 0.0, 0.0, 0.25], [0.0, 0.0, 2.0, -0.5], [0, 0, 0, 1]]

CLOUD = "cloud AS (SELECT vec_id AS idx, CAST(label AS INTEGER) AS label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
GRID = CLOUD + ", grid AS (SELECT label AS volume, CAST(trunc(x * 8 + 8) AS INTEGER) AS x, CAST(trunc(y * 8 + 8) AS INTEGER) AS y, CAST(trunc(z * 8 + 8) AS INTEGER) AS z, CAST(count(*) AS DOUBLE) AS value FROM cloud GROUP BY ALL)"
BOXES = CLOUD + ", boxes AS (SELECT label AS box, " + ", ".join(f"(min({c}) + max({c})) / 2 - (max({c}) - min({c})) / 4 AS {c}0, (min({c}) + max({c})) / 2 + (max({c}) - min({c})) / 4 AS {c}1" for c in "xyz") + " FROM cloud GROUP BY label)"
BOX = ", ".join(f"round({c}{i}, 6) AS {c}{i}" for i in (0, 1) for c in "xyz")


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.col("label").cast("int").alias("label"), *[e[i].cast("double").alias(c) for i, c in enumerate("xyz")])


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = voxels.voxel_of(cloud(spark, sf_dir), TO_VOXEL, half=False)
    counts = p.groupBy(F.col("label").alias("volume"), *[F.col("v" + c).alias(c) for c in "xyz"]).agg(F.count("*").cast("double").alias("value"))
    return counts.select(F.lit("m").alias("map_id"), "volume", F.lit(None).cast("string").alias("fragment"), "x", "y", "z", "value")


def index(rows: DataFrame) -> DataFrame:
    return rows.select("map_id", "volume", "fragment").distinct().select("map_id", F.concat(F.lit("region "), F.col("volume")).alias("region"), "volume", "fragment", F.lit(None).cast("double").alias("label"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locations.zoom(locations.bounding_box(cloud(spark, sf_dir), "label").withColumnRenamed("label", "box"), 0.5)


def rounded(df: DataFrame, *keys: str, places: int = 6) -> DataFrame:
    return df.select(*keys, *[F.round(c, places).alias(c) for c in df.columns if c not in keys])


@query(f"WITH {GRID} SELECT 'region ' || g.volume AS region, count(*) AS n, round(avg(c.x), 6) AS x, round(avg(c.y), 6) AS y, round(avg(c.z), 6) AS z, round(avg(g.value), 9) AS map_value FROM cloud c JOIN grid g ON g.x = CAST(trunc(c.x * 8 + 8.5) AS INTEGER) AND g.y = CAST(trunc(c.y * 8 + 8.5) AS INTEGER) AND g.z = CAST(trunc(c.z * 8 + 8.5) AS INTEGER) WHERE g.value > 1 GROUP BY 1")
def assign_points(spark, sf_dir):
    g = grid(spark, sf_dir)
    got = assignment.assign_points(cloud(spark, sf_dir), g, index(g), TO_VOXEL, threshold=1.0)
    c = F.col("centroid")
    return got.groupBy("region").agg(F.count("*").alias("n"), *[F.round(F.avg(c[i]), 6).alias(a) for i, a in enumerate("xyz")], F.round(F.avg("map_value"), 9).alias("map_value"))


@query(f"WITH {GRID} SELECT c.idx, g.volume, g.value FROM cloud c JOIN grid g ON g.x = CAST(trunc(c.x * 8 + 8) AS INTEGER) AND g.y = CAST(trunc(c.y * 8 + 8) AS INTEGER) AND g.z = CAST(trunc(c.z * 8 + 8) AS INTEGER)")
def read_voxels(spark, sf_dir):
    return voxels.read(voxels.voxel_of(cloud(spark, sf_dir), TO_VOXEL, half=False), grid(spark, sf_dir)).select("idx", "volume", "value")


@query(f"WITH {GRID} SELECT idx, label FROM cloud c WHERE EXISTS (SELECT 1 FROM grid g WHERE g.volume = 3 AND g.x = CAST(trunc(c.x * 8 + 8) AS INTEGER) AND g.y = CAST(trunc(c.y * 8 + 8) AS INTEGER) AND g.z = CAST(trunc(c.z * 8 + 8) AS INTEGER))")
def points_inside_mask(spark, sf_dir):
    return voxels.points_inside(voxels.voxel_of(cloud(spark, sf_dir), TO_VOXEL, half=False), voxels.select(grid(spark, sf_dir), volume=3)).select("idx", "label")


@query(f"WITH {GRID} SELECT c.idx, coalesce(g.value, 0) AS value FROM cloud c LEFT JOIN grid g ON g.volume = 1 AND g.x > 0 AND g.y > 0 AND g.z > 0 AND g.x = CAST(trunc(c.x * 8 + 8) AS INTEGER) AND g.y = CAST(trunc(c.y * 8 + 8) AS INTEGER) AND g.z = CAST(trunc(c.z * 8 + 8) AS INTEGER)")
def evaluate_points(spark, sf_dir):
    return voxels.evaluate(voxels.voxel_of(cloud(spark, sf_dir), TO_VOXEL, half=False), voxels.select(grid(spark, sf_dir), volume=1)).select("idx", "value")


@query(f"WITH {BOXES} SELECT b.box, count(*) AS points, CAST(sum(c.idx) AS BIGINT) AS ids FROM cloud c JOIN boxes b ON c.x BETWEEN b.x0 AND b.x1 AND c.y BETWEEN b.y0 AND b.y1 AND c.z BETWEEN b.z0 AND b.z1 GROUP BY b.box")
def points_in_boxes(spark, sf_dir):
    return locations.points_in_boxes(cloud(spark, sf_dir), boxes(spark, sf_dir)).groupBy("box").agg(F.count("*").alias("points"), F.sum("idx").alias("ids"))


_SHARED = ", ".join(f"greatest(a.{c}0, b.{c}0) AS {c}0, least(a.{c}1, b.{c}1) AS {c}1" for c in "xyz")
_MEET = " AND ".join(f"greatest(a.{c}0, b.{c}0) < least(a.{c}1, b.{c}1)" for c in "xyz")


@query(f"WITH {BOXES}, x AS (SELECT a.box AS a, b.box AS b, {_SHARED} FROM boxes a JOIN boxes b ON {_MEET}) SELECT a, b, {BOX} FROM x")
def intersect_boxes(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return rounded(locations.intersect_boxes(b.withColumnRenamed("box", "a"), b.withColumnRenamed("box", "b"), "a", "b"), "a", "b")


_IN = lambda p, q: " AND ".join(f"{p}.{c}0 >= {q}.{c}0 AND {p}.{c}1 <= {q}.{c}1" for c in "xyz")


@query(f"WITH {BOXES}, wide AS (SELECT label AS big, " + ", ".join(f"min({c}) AS {c}0, max({c}) AS {c}1" for c in "xyz") + f" FROM cloud GROUP BY label) SELECT a.box, b.big, CASE WHEN {_IN('a', 'b')} AND {_IN('b', 'a')} THEN 'EXACT' WHEN {_IN('a', 'b')} THEN 'CONTAINED' WHEN {_IN('b', 'a')} THEN 'CONTAINS' ELSE 'OVERLAPS' END AS how FROM boxes a JOIN wide b ON {_MEET}")
def box_relations(spark, sf_dir):
    a, b = boxes(spark, sf_dir), locations.bounding_box(cloud(spark, sf_dir), "label").withColumnRenamed("label", "big")
    pairs = locations.intersect_boxes(a, b, "box", "big").select("box", "big")
    full = pairs.join(a, "box").join(b.select("big", *[F.col(c).alias(c + "_b") for c in (*locations.LOW, *locations.HIGH)]), "big")
    return full.select("box", "big", locations.relation().alias("how"))


@query(f"WITH {GRID} SELECT a.x, a.y, a.z, least(a.value, b.value) AS value FROM grid a JOIN grid b USING (x, y, z) WHERE a.volume = 1 AND b.volume = 2")
def pointwise_minimum(spark, sf_dir):
    g = grid(spark, sf_dir)
    return voxels.minimum(voxels.select(g, volume=1), voxels.select(g, volume=2))


@query(f"WITH {GRID} SELECT volume, " + ", ".join(f"min({c}) AS {c}0, max({c}) + 1 AS {c}1" for c in "xyz") + " FROM grid GROUP BY volume")
def voxel_bounding_box(spark, sf_dir):
    return voxels.bounding_box(grid(spark, sf_dir), "volume")


@query(
    f"WITH {CLOUD}, s AS (SELECT *, (idx % 7) / 10.0 AS sigma FROM cloud) SELECT label, {', '.join(f'round(min({c}), 6) AS {c}0, round(max({c}), 6) AS {c}1' for c in 'xyz')}, round(greatest(arg_min(sigma, x), arg_min(sigma, y), arg_min(sigma, z)), 6) AS s0, round(greatest(arg_max(sigma, x), arg_max(sigma, y), arg_max(sigma, z)), 6) AS s1 FROM s GROUP BY label"
)
def cloud_bounding_box(spark, sf_dir):
    p = cloud(spark, sf_dir).withColumn("sigma", (F.col("idx") % 7) / 10.0)
    return rounded(locations.bounding_box(p, "label", sigma="sigma"), "label")


@query(f"WITH {CLOUD} SELECT label, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM cloud GROUP BY label")
def cloud_centroid(spark, sf_dir):
    return rounded(locations.centroid(cloud(spark, sf_dir), "label"), "label", "n")


@query(f"WITH {GRID} SELECT volume AS region, round(avg(x) / 8 - 1, 9) AS x, round(avg(y) / 8 - 1, 9) AS y, round(avg(z) / 8 - 1, 9) AS z, count(*) AS voxels, round(count(*) / 512.0, 9) AS volume FROM grid GROUP BY 1")
def region_spatial_props(spark, sf_dir):
    got = voxels.spatial_props(grid(spark, sf_dir).withColumnRenamed("volume", "region"), TO_MM, "region")
    return got.select("region", *[F.round(c, 9).alias(c) for c in "xyz"], "voxels", F.round("volume", 9).alias("volume"))


def _compared(n: str, over: str) -> str:
    return f"""
WITH {GRID}, p AS (
  SELECT x, y, z, coalesce(a.value, 0) AS a, coalesce(b.value, 0) AS b FROM (SELECT * FROM grid WHERE volume = 1) a FULL JOIN (SELECT * FROM grid WHERE volume = 2) b USING (x, y, z)
), s AS (
  SELECT count(*) FILTER (a > 0 AND b > 0) AS n_both, count(*) FILTER (a > 0) AS na, count(*) FILTER (b > 0) AS nb, count(*) AS u, sum(a) AS sa, sum(b) AS sb, sum(a * b) AS sab, sum(a * a) AS saa, sum(b * b) AS sbb, {n} AS n, {over} AS o FROM p
), m AS (SELECT *, sa / n AS ma, sb / n AS mb FROM s)
SELECT round(n_both / u, 6) AS iou, round(n_both / nb, 6) AS b_contained, round(n_both / na, 6) AS a_contained, round((sab - mb * sa - ma * sb + o * ma * mb) / sqrt((saa - 2 * ma * sa + o * ma * ma) * (sbb - 2 * mb * sb + o * mb * mb)), 6) AS correlation, round(sab / sb, 6) AS weighted_mean_of_a, round(sab / sa, 6) AS weighted_mean_of_b, n_both FROM m
"""


@query(_compared("4096.0", "count(*)"))
def compare_images_dense(spark, sf_dir):
    g = grid(spark, sf_dir)
    return rounded(similarity.compare(similarity.paired(voxels.select(g, volume=1), voxels.select(g, volume=2)), size=4096, dense=True), "n_both")


@query(_compared("4096.0", "4096.0"))
def compare_images(spark, sf_dir):
    g = grid(spark, sf_dir)
    return rounded(similarity.compare(similarity.paired(voxels.select(g, volume=1), voxels.select(g, volume=2)), size=4096), "n_both")


def _across(parts: str) -> str:
    return f"""
WITH {GRID}, m AS (SELECT volume AS region, x, y, z, value AS a FROM grid), q AS (SELECT volume AS part, x, y, z, value AS b FROM grid{parts}),
am AS (SELECT region, count(*) AS na, sum(a) AS sa, sum(a * a) AS saa, max(a) AS ma, {', '.join(f'min({c}) AS a{c}0, max({c}) AS a{c}1' for c in 'xyz')} FROM m GROUP BY region),
aq AS (SELECT part, count(*) AS nb, sum(b) AS sb, sum(b * b) AS sbb, {', '.join(f'min({c}) AS b{c}0, max({c}) AS b{c}1' for c in 'xyz')} FROM q GROUP BY part),
t AS (SELECT region, part, count(*) AS nab, sum(a * b) AS sab FROM m JOIN q USING (x, y, z) GROUP BY ALL),
f AS (SELECT *, {' * '.join(f'(greatest(a{c}1, b{c}1 + 1) - least(a{c}0, b{c}0))' for c in 'xyz')} * 1.0 AS n FROM t JOIN am USING (region) JOIN aq USING (part)),
v AS (SELECT *, sqrt(greatest((saa - sa * sa / n) * (sbb - sb * sb / n), 0)) AS root FROM f)
SELECT region, part, round(nab / (na + nb - nab), 6) AS iou, round(nab / nb, 6) AS input_contained, round(nab / na, 6) AS map_contained, round(CASE WHEN root > 0 THEN (sab - sa * sb / n) / root ELSE 0 END, 6) AS correlation, round(sab / sb, 6) AS map_weighted_mean, round(sab / sa, 6) AS input_weighted_mean, ma AS map_value FROM v
"""


@query(_across(" WHERE volume < 3 AND value > 1"))
def compare_regions_with_parts(spark, sf_dir):
    g = grid(spark, sf_dir)
    q = g.filter("volume < 3 and value > 1").withColumnRenamed("volume", "part")
    return rounded(similarity.compare_across(g.withColumnRenamed("volume", "region"), q, "region", "part"), "region", "part", "map_value")


@query(_across(""))
def compare_regions_with_all_parts(spark, sf_dir):
    g = grid(spark, sf_dir)
    return rounded(similarity.compare_across(g.withColumnRenamed("volume", "region"), g.withColumnRenamed("volume", "part"), "region", "part"), "region", "part", "map_value")


@query("""
WITH b AS (SELECT l_quantity AS a, l_discount AS b FROM lineitem), e AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1 FROM b),
j AS (SELECT least(floor((a - a0) * 10 / (a1 - a0)), 9) AS i, least(floor((b - b0) * 10 / (b1 - b0)), 9) AS j, count(*) AS n FROM b, e GROUP BY ALL),
m AS (SELECT n * 1.0 AS n, sum(n) OVER (PARTITION BY i) * 1.0 AS ni, sum(n) OVER (PARTITION BY j) * 1.0 AS nj, sum(n) OVER () * 1.0 AS t FROM j)
SELECT round(sum(n / t * ln(n * t / (ni * nj))), 9) AS mi FROM m
""")
def mutual_information(spark, sf_dir):
    return similarity.mutual_information(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), F.col("l_discount").alias("b")), bins=10).select(F.round("mi", 9).alias("mi"))


@query(f"WITH {GRID} SELECT x, y, z, CAST(arg_max(volume, value * 1000 - volume) AS INTEGER) AS label, max(value) AS value FROM grid GROUP BY x, y, z")
def argmax_map(spark, sf_dir):
    return voxels.argmax(grid(spark, sf_dir).withColumnRenamed("volume", "label"))


@query(f"WITH {GRID} SELECT x, y, z, CAST(arg_max(volume, value * 1000 - volume) + 1 AS INTEGER) AS value FROM grid GROUP BY x, y, z")
def compress_map(spark, sf_dir):
    return voxels.compress(grid(spark, sf_dir))


@query(f"WITH {GRID} SELECT x, y, z, arg_max(value, volume) AS value, count(*) AS n_writers FROM grid GROUP BY x, y, z")
def merge_volumes(spark, sf_dir):
    return voxels.merge(grid(spark, sf_dir))


@query(f"WITH {GRID} SELECT DISTINCT 'region ' || volume AS region, volume, CAST(dense_rank() OVER (ORDER BY volume) AS INTEGER) AS new_label FROM grid")
def relabel_regions(spark, sf_dir):
    return voxels.relabel(index(grid(spark, sf_dir))).select("region", "volume", "new_label")


@query(f"WITH {GRID} SELECT CAST(floor((x / 8.0 - 1 + 1) * 4 + 0.5) AS INTEGER) AS x, CAST(floor((y / 8.0 - 1 + 1) * 4 + 0.5) AS INTEGER) AS y, CAST(floor((z / 8.0 - 1 + 1) * 4 + 0.5) AS INTEGER) AS z, max(value) AS value FROM grid WHERE volume = 1 GROUP BY 1, 2, 3")
def resample_nearest(spark, sf_dir):
    target = [[0.25, 0, 0, -1], [0, 0.25, 0, -1], [0, 0, 0.25, -1], [0, 0, 0, 1]]
    return voxels.resample_nearest(voxels.select(grid(spark, sf_dir), volume=1), TO_MM, target)


@query(f"""
WITH {GRID}, t AS (SELECT DISTINCT x * 2 + i AS x, y * 2 + j AS y, z * 2 + k AS z FROM grid, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j), (VALUES (-1), (0), (1)) c(k) WHERE volume = 1),
w AS (SELECT t.x, t.y, t.z, g.value * greatest(0, 1 - abs(t.x / 2.0 - g.x)) * greatest(0, 1 - abs(t.y / 2.0 - g.y)) * greatest(0, 1 - abs(t.z / 2.0 - g.z)) AS v FROM t JOIN grid g ON g.volume = 1 AND abs(t.x / 2.0 - g.x) < 1 AND abs(t.y / 2.0 - g.y) < 1 AND abs(t.z / 2.0 - g.z) < 1)
SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z, round(sum(v), 6) AS value FROM w GROUP BY 1, 2, 3
""")
def resample_linear(spark, sf_dir):
    target = [[0.0625, 0, 0, -1], [0, 0.0625, 0, -1], [0, 0, 0.0625, -1], [0, 0, 0, 1]]
    return rounded(voxels.resample_linear(voxels.select(grid(spark, sf_dir), volume=1), TO_MM, target), "x", "y", "z")


@query(f"""
WITH {CLOUD}, p AS (SELECT CAST(trunc(x * 8 + 8) AS INTEGER) AS x, CAST(trunc(y * 8 + 8) AS INTEGER) AS y, CAST(trunc(z * 8 + 8) AS INTEGER) AS z FROM cloud), o AS (SELECT * FROM (VALUES (-1), (0), (1)) t(d)), l AS (SELECT d, exp(-d * d / 0.5) / (SELECT sum(exp(-d * d / 0.5)) FROM o) AS w FROM o)
SELECT p.x + a.d AS x, p.y + b.d AS y, p.z + c.d AS z, round(sum(a.w * b.w * c.w) / (SELECT count(*) FROM p), 9) AS value FROM p, l a, l b, l c GROUP BY 1, 2, 3
""")
def point_density(spark, sf_dir):
    p = voxels.voxel_of(cloud(spark, sf_dir), TO_VOXEL, half=False).select(*[F.col("v" + c).alias(c) for c in "xyz"])
    return rounded(voxels.density(p, 0.5, reach=2), "x", "y", "z", places=9)


@query(f"""
WITH {CLOUD}, p AS (SELECT CAST(trunc(x * 8 + 8) AS INTEGER) AS x, CAST(trunc(y * 8 + 8) AS INTEGER) AS y, CAST(trunc(z * 8 + 8) AS INTEGER) AS z, count(*) AS n FROM cloud GROUP BY ALL), o AS (SELECT CAST(d AS INTEGER) AS d FROM range(-9, 10) t(d)), l AS (SELECT d, exp(-d * d / 18.0) / (SELECT sum(exp(-d * d / 18.0)) FROM o) AS w FROM o)
SELECT p.x + a.d AS x, p.y + b.d AS y, p.z + c.d AS z, round(sum(n * a.w * b.w * c.w) / (SELECT sum(n) FROM p), 9) AS value FROM p, l a, l b, l c GROUP BY 1, 2, 3
""")
def point_density_wide(spark, sf_dir):
    """A kernel of three voxels' width."""
    p = voxels.voxel_of(cloud(spark, sf_dir), TO_VOXEL, half=False).select(*[F.col("v" + c).alias(c) for c in "xyz"])
    return rounded(voxels.density(p, 3.0), "x", "y", "z", places=9)


@query(f"WITH {GRID} SELECT x, y, z, arg_max(CAST(volume * 10.0 AS DOUBLE), value * 1000 + volume) AS value FROM grid GROUP BY x, y, z")
def colorize_map(spark, sf_dir):
    g = grid(spark, sf_dir)
    i = index(g)
    return voxels.colorize(g, i, i.select("region", (F.col("volume") * 10.0).alias("value"))).select("x", "y", "z", F.col("value").cast("double").alias("value"))


@query(f"WITH {GRID} SELECT DISTINCT x, y, z, CAST(1.0 AS DOUBLE) AS value FROM grid WHERE volume IN (2, 5) AND value > 1")
def region_mask(spark, sf_dir):
    g = grid(spark, sf_dir)
    return voxels.region_mask(g, index(g), spark.createDataFrame([("region 2",), ("region 5",)], "region string"), threshold=1.0)


_CELLS = GRID + ", c AS (SELECT DISTINCT x, y, z, CAST(x AS BIGINT) * 1099511627776 + CAST(y AS BIGINT) * 1048576 + z AS id FROM grid WHERE value > 1)"


@query(f"WITH RECURSIVE {_CELLS}, e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1), r AS (SELECT id, id AS root FROM c UNION SELECT e.b AS id, r.root FROM r JOIN e ON r.id = e.a) SELECT x, y, z, min(root) AS component FROM c JOIN r USING (id) GROUP BY x, y, z")
def connected_components(spark, sf_dir):
    return components.label_mask(voxels.select(grid(spark, sf_dir), threshold=1.0), connectivity=1)


@query(f"WITH RECURSIVE {GRID}, c AS (SELECT DISTINCT x - 9 AS x, y - 9 AS y, z - 9 AS z FROM grid WHERE value > 1), i AS (SELECT x, y, z, CAST(x - least(min(x) OVER (), 0) AS BIGINT) * 1099511627776 + CAST(y - least(min(y) OVER (), 0) AS BIGINT) * 1048576 + (z - least(min(z) OVER (), 0)) AS id FROM c), e AS (SELECT a.id AS a, b.id AS b FROM i a JOIN i b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 AND a.id <> b.id AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) <= 2), r AS (SELECT id, id AS root FROM i UNION SELECT e.b AS id, r.root FROM r JOIN e ON r.id = e.a) SELECT x, y, z, min(root) AS component FROM i JOIN r USING (id) GROUP BY x, y, z")
def connected_components_around_origin(spark, sf_dir):
    """Neighbours by edge on a grid with negative places."""
    mask = voxels.select(grid(spark, sf_dir), threshold=1.0)
    return components.label_mask(mask.withColumns({c: F.col(c) - 9 for c in "xyz"}))


@query(f"WITH {GRID} SELECT x, y, z, value FROM grid g WHERE volume = 0 AND NOT EXISTS (SELECT 1 FROM grid h WHERE h.volume = 0 AND abs(g.x - h.x) <= 1 AND abs(g.y - h.y) <= 1 AND abs(g.z - h.z) <= 1 AND (h.value > g.value OR h.value = g.value AND (h.x, h.y, h.z) < (g.x, g.y, g.z)))")
def local_peaks(spark, sf_dir):
    return voxels.local_peaks(voxels.select(grid(spark, sf_dir), volume=0))


@query(f"WITH {GRID} SELECT volume, x, y, z, value FROM grid g WHERE NOT EXISTS (SELECT 1 FROM grid h WHERE h.volume = g.volume AND abs(g.x - h.x) <= 1 AND abs(g.y - h.y) <= 1 AND abs(g.z - h.z) <= 1 AND (h.value > g.value OR h.value = g.value AND (h.x, h.y, h.z) < (g.x, g.y, g.z)))")
def local_peaks_by_volume(spark, sf_dir):
    return voxels.local_peaks(grid(spark, sf_dir), by=("volume",))


@query(f"WITH {CLOUD} SELECT DISTINCT x, y, z FROM (SELECT * FROM cloud WHERE label < 3 UNION ALL SELECT * FROM cloud WHERE label > 1 AND label < 5)")
def union_points(spark, sf_dir):
    c = cloud(spark, sf_dir)
    return locations.union_points(c.filter("label < 3"), c.filter("label > 1 and label < 5"))


@query(f"WITH {CLOUD} SELECT idx, label FROM cloud a WHERE label < 3 AND EXISTS (SELECT 1 FROM cloud b WHERE b.label > 1 AND a.x = b.x AND a.y = b.y AND a.z = b.z)")
def shared_points(spark, sf_dir):
    c = cloud(spark, sf_dir)
    return locations.shared_points(c.filter("label < 3"), c.filter("label > 1")).select("idx", "label")


@query(f"WITH {BOXES} SELECT {', '.join(f'round(min({c}0), 6) AS {c}0, round(max({c}1), 6) AS {c}1' for c in 'xyz')} FROM boxes")
def union_boxes(spark, sf_dir):
    return rounded(locations.union_boxes(boxes(spark, sf_dir)))


@query(f"WITH {BOXES} SELECT box, CAST(i AS INTEGER) AS corner, round(CASE WHEN i & 1 = 1 THEN x1 ELSE x0 END, 6) AS x, round(CASE WHEN i & 2 = 2 THEN y1 ELSE y0 END, 6) AS y, round(CASE WHEN i & 4 = 4 THEN z1 ELSE z0 END, 6) AS z FROM boxes, range(8) r(i)")
def box_corners(spark, sf_dir):
    return rounded(locations.corners(boxes(spark, sf_dir)).select("box", "corner", "x", "y", "z"), "box", "corner")


@query(f"WITH {BOXES} SELECT box, round(0.5 - y1, 6) AS x0, round(x0 + 0.25, 6) AS y0, round(2 * z0 - 0.5, 6) AS z0, round(0.5 - y0, 6) AS x1, round(x1 + 0.25, 6) AS y1, round(2 * z1 - 0.5, 6) AS z1 FROM boxes")
def transform_boxes(spark, sf_dir):
    return rounded(locations.transform_boxes(boxes(spark, sf_dir), ROTATED, "box"), "box")


@query(f"WITH {CLOUD} SELECT idx, round(0.5 - y, 6) AS x, round(x + 0.25, 6) AS y, round(2 * z - 0.5, 6) AS z FROM cloud")
def transform_points(spark, sf_dir):
    return rounded(locations.transform_points(cloud(spark, sf_dir), ROTATED).drop("label"), "idx")


@query(f"WITH {BOXES} SELECT box, {', '.join(f'round({c}{i} + {v}, 6) AS {c}{i}' for c, v in zip('xyz', (1, 2, 3), strict=True) for i in (0, 1))} FROM boxes")
def shift_boxes(spark, sf_dir):
    return rounded(locations.shift(boxes(spark, sf_dir), (1, 2, 3)), "box")


@query(f"WITH {CLOUD} SELECT idx, {', '.join(f'round({c} - 0.25, 6) AS {c}0, round({c} + 0.25, 6) AS {c}1' for c in 'xyz')} FROM cloud")
def enclosing_cubes(spark, sf_dir):
    return rounded(locations.enclosing_cubes(cloud(spark, sf_dir), 0.5).drop("x", "y", "z", "label"), "idx")


@query(f"WITH {CLOUD}, d AS (SELECT a.idx, b.idx AS target, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM cloud a, cloud b WHERE a.label < 5 AND b.label >= 5) SELECT idx, arg_min(target, d) AS target, round(min(d), 6) AS distance FROM d GROUP BY idx")
def nearest_point(spark, sf_dir):
    c = cloud(spark, sf_dir)
    return rounded(locations.nearest(c.filter("label < 5"), c.filter("label >= 5").withColumnRenamed("idx", "target"), "idx", "target", 0.05), "idx", "target")


@query(f"WITH {CLOUD}, s AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY label ORDER BY idx) > 1 THEN 1 ELSE 0 END AS j FROM cloud) SELECT idx, label, CAST(sum(j) OVER (PARTITION BY label ORDER BY idx) AS BIGINT) AS segment FROM s")
def contour_segments(spark, sf_dir):
    return locations.contour_segments(cloud(spark, sf_dir), "label").select("idx", "label", "segment")


_LINE = CLOUD + ", s AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS step FROM cloud WINDOW w AS (PARTITION BY label ORDER BY idx)), l AS (SELECT *, sum(step) OVER (PARTITION BY label ORDER BY idx) AS length FROM s)"


@query(f"WITH {_LINE} SELECT idx, label, round(length, 6) AS length FROM l")
def arc_length(spark, sf_dir):
    return locations.arc_length(cloud(spark, sf_dir), "label").select("idx", "label", F.round("length", 6).alias("length"))


@query(f"WITH {_LINE}, p AS (SELECT *, lead(length) OVER w AS e, lead(x) OVER w AS xx, lead(y) OVER w AS yy, max(length) OVER (PARTITION BY label) AS whole FROM l WINDOW w AS (PARTITION BY label ORDER BY idx)), t AS (SELECT p.*, k, (k * whole / 10 - length) / (e - length) AS u FROM p JOIN range(11) r(k) ON e > length AND k * whole / 10 >= length - 1e-9 AND (k * whole / 10 < e - 1e-9 OR k = 10 AND e = whole)) SELECT label, k, round(x + u * (xx - x), 5) AS x, round(y + u * (yy - y), 5) AS y FROM t")
def resample_line(spark, sf_dir):
    return rounded(locations.resample_line(cloud(spark, sf_dir), 11, "label"), "label", "k", places=5)


@query(f"WITH {CLOUD} SELECT idx, CAST(0.6 * x + 0.8 * z >= 0.02 AS INTEGER) AS side, round(x - (0.6 * x + 0.8 * z - 0.02) * 0.6, 6) AS x, round(y, 6) AS y, round(z - (0.6 * x + 0.8 * z - 0.02) * 0.8, 6) AS z FROM cloud")
def plane_projection(spark, sf_dir):
    p = [F.col(c) for c in "xyz"]
    foot = G.project(NORMAL, DISTANCE, *p)
    return cloud(spark, sf_dir).select("idx", G.sidedness(NORMAL, DISTANCE, *p).alias("side"), *[F.round(f, 6).alias(c) for c, f in zip("xyz", foot, strict=True)])


@query(f"WITH {CLOUD}, s AS (SELECT a.idx, a.x, a.y, a.z, b.x AS bx, b.y AS b_y, b.z AS bz, 0.6 * a.x + 0.8 * a.z AS da, 0.6 * b.x + 0.8 * b.z AS db FROM cloud a JOIN cloud b ON b.idx = a.idx + 1), t AS (SELECT *, (0.02 - da) / (db - da) AS t FROM s WHERE db <> da) SELECT idx, round(x + t * (bx - x), 6) AS x, round(y + t * (b_y - y), 6) AS y, round(z + t * (bz - z), 6) AS z FROM t WHERE t BETWEEN 0 AND 1")
def plane_segment_hits(spark, sf_dir):
    c = cloud(spark, sf_dir)
    nxt = c.select((F.col("idx") - 1).alias("idx"), *[F.col(v).alias("n" + v) for v in "xyz"])
    hit = G.segment_hit(NORMAL, DISTANCE, [F.col(v) for v in "xyz"], [F.col("n" + v) for v in "xyz"])
    return rounded(c.join(nxt, "idx").select("idx", hit.alias("h")).filter("h is not null").select("idx", "h.*"), "idx")


@query(f"WITH {CLOUD} SELECT idx, CAST(trunc((y + 70) / 0.02 + 1.5) AS INTEGER) AS section, round(pow(abs(x), 3) * pi() * 4 / 3, 9) AS volume FROM cloud")
def point_scalars(spark, sf_dir):
    return cloud(spark, sf_dir).select("idx", G.section_number(F.col("y")).alias("section"), F.round(G.sphere_volume(F.abs("x")), 9).alias("volume"))


@query(f"WITH {BOXES} SELECT box, round((x1 - x0) * (y1 - y0) * (z1 - z0), 9) AS volume, round((x0 + x1) / 2, 6) AS cx FROM boxes")
def box_volume(spark, sf_dir):
    v = G.box_volume([F.col(c) for c in locations.LOW], [F.col(c) for c in locations.HIGH], F.lit(0.0), F.lit(0.0))
    return boxes(spark, sf_dir).select("box", F.round(v, 9).alias("volume"), F.round((F.col("x0") + F.col("x1")) / 2, 6).alias("cx"))


def _mesh(spark, sf_dir):
    """Vertices in label fragments, and faces between three vertices in a row."""
    c = cloud(spark, sf_dir).withColumn("vid", F.row_number().over(Window.partitionBy("label").orderBy("idx")) - 1)
    verts = c.select(F.lit("s").alias("mesh"), F.col("label").cast("string").alias("fragment"), "vid", "x", "y", "z", "label")
    last = c.groupBy("label").agg(F.max("vid").alias("m"))
    faces = c.join(last, "label").filter("vid + 2 <= m").select(F.lit("s").alias("mesh"), F.col("label").cast("string").alias("fragment"), F.col("vid").alias("fid"), F.col("vid").alias("v0"), (F.col("vid") + 1).alias("v1"), (F.col("vid") + 2).alias("v2"))
    return verts, faces


_VERTS = CLOUD + ", v AS (SELECT label, x, y, z, row_number() OVER (PARTITION BY label ORDER BY idx) - 1 AS i, row_number() OVER (ORDER BY CAST(label AS VARCHAR), idx) - 1 AS vid, count(*) OVER (PARTITION BY label) AS n FROM cloud)"


@query(f"WITH {_VERTS} SELECT CAST(label AS VARCHAR) AS fragment, i AS fid, vid AS v0, vid + 1 AS v1, vid + 2 AS v2 FROM v WHERE i + 2 < n")
def merge_mesh(spark, sf_dir):
    _, faces = meshes.merge(*_mesh(spark, sf_dir))
    return faces.select("fragment", F.col("fid").cast("long").alias("fid"), *[F.col(c).cast("long").alias(c) for c in ("v0", "v1", "v2")])


@query(f"WITH {_VERTS}, s AS (SELECT vid, label, i, n, 0.6 * x + 0.8 * z >= 0.02 AS side FROM v) SELECT CAST(a.vid AS BIGINT) AS v0 FROM s a JOIN s b ON b.vid = a.vid + 1 AND b.label = a.label JOIN s c ON c.vid = a.vid + 2 AND c.label = a.label WHERE NOT (a.side = b.side AND b.side = c.side)")
def plane_cut_mesh(spark, sf_dir):
    verts, faces = meshes.merge(*_mesh(spark, sf_dir))
    cut = meshes.plane_cut(verts.select("mesh", "vid", "x", "y", "z"), faces.withColumn("fid", F.col("v0")).drop("fragment"), NORMAL, DISTANCE)
    return cut.select(F.col("fid").cast("long").alias("v0"))


#: Faces between three vertices in a row share their edges with the faces before and behind: lines are runs of crossed faces.
_CONTOURS = f"""
WITH {_VERTS}, s AS (SELECT label, vid, n, i, x, y, z, 0.6 * x + 0.8 * z AS h FROM v), w AS (
  SELECT vid AS f, vid - i AS base, h >= 0.02 AS s0, lead(h >= 0.02, 1) OVER o AS s1, lead(h >= 0.02, 2) OVER o AS s2,
    [{{'x': x, 'y': y, 'z': z, 'h': h}}, {{'x': lead(x, 1) OVER o, 'y': lead(y, 1) OVER o, 'z': lead(z, 1) OVER o, 'h': lead(h, 1) OVER o}}, {{'x': lead(x, 2) OVER o, 'y': lead(y, 2) OVER o, 'z': lead(z, 2) OVER o, 'h': lead(h, 2) OVER o}}] AS p, label
  FROM s WINDOW o AS (PARTITION BY label ORDER BY vid)
), c AS (
  SELECT label, f, p, CASE WHEN s0 <> s1 THEN 0 ELSE 2 END AS ein, CASE WHEN s1 <> s2 THEN 1 ELSE 2 END AS eout, s0 <> s1 AND lag(f) OVER (PARTITION BY label ORDER BY f) = f - 1 AS goes
  FROM w WHERE p[3].x IS NOT NULL AND NOT (s0 = s1 AND s1 = s2)
), r AS (SELECT *, sum(CASE WHEN goes THEN 0 ELSE 1 END) OVER (ORDER BY label, f) AS run FROM c),
e AS (SELECT *, CAST(f + CASE ein WHEN 0 THEN 0 ELSE 0 END AS VARCHAR) || '-' || CAST(f + CASE ein WHEN 0 THEN 1 ELSE 2 END AS VARCHAR) AS first,
  CAST(f + CASE eout WHEN 1 THEN 1 ELSE 0 END AS VARCHAR) || '-' || CAST(f + 2 AS VARCHAR) AS last, row_number() OVER (PARTITION BY run ORDER BY f) - 1 AS j, count(*) OVER (PARTITION BY run) AS m FROM r),
q AS (SELECT *, p[1] AS a, p[CASE ein WHEN 0 THEN 2 ELSE 3 END] AS b, p[CASE eout WHEN 1 THEN 2 ELSE 1 END] AS c, p[3] AS d FROM e),
k AS (SELECT run, m, j, f, first, last, a.x + (0.02 - a.h) / (b.h - a.h) * (b.x - a.x) AS x0, a.y + (0.02 - a.h) / (b.h - a.h) * (b.y - a.y) AS y0, a.z + (0.02 - a.h) / (b.h - a.h) * (b.z - a.z) AS z0,
  c.x + (0.02 - c.h) / (d.h - c.h) * (d.x - c.x) AS x1, c.y + (0.02 - c.h) / (d.h - c.h) * (d.y - c.y) AS y1, c.z + (0.02 - c.h) / (d.h - c.h) * (d.z - c.z) AS z1 FROM q),
t AS (SELECT run, arg_min(first, j) AS n0, min(f) AS f0, arg_max(last, j) AS n1, max(f) AS f1 FROM k GROUP BY run),
u AS (SELECT run, j, m, f AS fwd, CASE WHEN j > 0 THEN f - 1 END AS bwd, x0 AS x, y0 AS y, z0 AS z FROM k UNION ALL SELECT run, m, m, NULL, f, x1, y1, z1 FROM k WHERE j = m - 1)
SELECT CASE WHEN (n0, f0) < (n1, f1) THEN n0 || '/' || f0 ELSE n1 || '/' || f1 END AS contour, CAST(CASE WHEN (n0, f0) < (n1, f1) THEN j ELSE m - j END AS BIGINT) AS k,
  round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, CAST(CASE WHEN (n0, f0) < (n1, f1) THEN fwd ELSE bwd END AS BIGINT) AS fid, false AS closed
FROM u JOIN t USING (run)
"""


@query(_CONTOURS)
def plane_contours(spark, sf_dir):
    """The lines of the cut in order."""
    verts, faces = meshes.merge(*_mesh(spark, sf_dir))
    got = meshes.contours(verts.select("mesh", "vid", "x", "y", "z"), faces.withColumn("fid", F.col("v0")).drop("fragment"), NORMAL, DISTANCE)
    return rounded(got.drop("mesh").withColumn("fid", F.col("fid").cast("long")), "contour", "k", "fid", "closed")


@query()
def cluster_points(spark, sf_dir):
    return density.find_clusters(cloud(spark, sf_dir).withColumn("cloud_id", F.lit(0)), least=1 / 50, most=1 / 2)


@query()
def draw_samples(spark, sf_dir):
    return voxels.draw(voxels.select(grid(spark, sf_dir), volume=1), 1000)


@query()
def assign_uncertain_points(spark, sf_dir):
    g = grid(spark, sf_dir)
    p = cloud(spark, sf_dir).withColumn("sigma", (F.col("idx") % 7) / 10.0 * 8)
    return assignment.assign_uncertain(p, g, index(g), TO_VOXEL, "sigma")


@query()
def assign_image(spark, sf_dir):
    g = grid(spark, sf_dir)
    return assignment.assign_image(voxels.select(g, volume=4, threshold=1.0), g, index(g))
