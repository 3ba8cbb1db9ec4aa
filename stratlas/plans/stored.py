"""Scalar functions on whole tables, and sources and sinks by writing a table and reading it back."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratlas.functions import geometry as G
from stratlas.functions import ids, names
from stratlas.operators import components, features, hierarchy, locations, registry, selection, voxels
from stratlas.plans import spatial, trees
from stratlas.plans.registry import query, table
from stratlas.session import shared_dir
from stratlas.sources import files, sinks


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"


# Functions of names and numbers.


@query("SELECT p_partkey, array_to_string(list_transform(string_split(replace(p_type, ' ', '_'), '_'), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '') AS camel, upper(regexp_replace(p_type, '\\s+', '_', 'g')) AS key, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS plain FROM part")
def species_names(spark, sf_dir):
    t = F.col("p_type")
    key = names.species_key(t)
    return table(spark, sf_dir, "part").select("p_partkey", names.snake_to_camel(F.replace(t, F.lit(" "), F.lit("_"))).alias("camel"), key.alias("key"), names.species_name(key).alias("plain"))


@query("SELECT p_partkey, p_brand || repeat('*', CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER)) AS label FROM part")
def duplicate_labels(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", names.duplicate_suffix(F.col("p_brand"), n).alias("label"))


@query("SELECT event_id, md5('space,' || CAST(event_id AS VARCHAR) || ',' || CAST(event_id % 7 AS VARCHAR) || ',' || CAST(event_id % 11 AS VARCHAR)) AS id FROM events")
def point_ids(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", ids.point_id(F.lit("space"), e, e % 7, e % 11).alias("id"))


@query("WITH h AS (SELECT p_partkey, list_reduce(list_transform(string_split(p_name, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda a, c: ((a * 31 + c + 2147483648 + 4294967296 * 64) % 4294967296) - 2147483648, CAST(0 AS BIGINT)) AS h FROM part) SELECT p_partkey, CASE WHEN h < 0 THEN lower(to_hex(abs(h))) ELSE substr(lower(to_hex(h)), 2) END AS hash FROM h")
def name_hashes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", ids.name_hash(F.col("p_name")).alias("hash"))


# Matrices, planes and boxes.

_A = 0.5
_CLOUD = spatial.CLOUD


@query(f"WITH {_CLOUD}, m AS (SELECT idx, x + 0.5 AS x, y + 0.5 AS y, z + 0.5 AS z FROM cloud) SELECT idx, round({math.cos(_A)!r} * x + {math.sin(_A)!r} * z + 1, 6) AS x, round(y + 2, 6) AS y, round({-math.sin(_A)!r} * x + {math.cos(_A)!r} * z + 3, 6) AS z FROM m")
def rotated_points(spark, sf_dir):
    """Rotation about y, then translation, shifted by half a voxel."""
    m = G.shift_half_voxel(G.compose(G.translation((1, 2, 3)), G.rotation_y(_A)))
    return spatial.rounded(locations.transform_points(spatial.cloud(spark, sf_dir), m).drop("label"), "idx")


@query(f"WITH {_CLOUD}, m AS (SELECT label, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM cloud GROUP BY label) SELECT label, {', '.join(f'round(({c}0 + {c}1) / 2 + {s} * ({c}1 - {c}0), 6) AS {c}{i}' for c in 'xyz' for i, s in ((0, -0.75), (1, 0.75)))} FROM m")
def zoomed_boxes(spark, sf_dir):
    return spatial.rounded(locations.zoom(locations.bounding_box(spatial.cloud(spark, sf_dir), "label"), 1.5), "label")


@query(f"WITH {_CLOUD} SELECT idx, CAST(2 * x + 3 * y + 6 * z >= 6 AS INTEGER) AS side FROM cloud WHERE abs(2 * x + 3 * y + 6 * z - 6) > 1e-9")
def plane_through_points(spark, sf_dir):
    """Which side of the plane that cuts the axes at 3, 2 and 1."""
    normal, d = G.plane_through([(3, 0, 0), (0, 2, 0), (0, 0, 1)])
    p = [F.col(c) for c in "xyz"]
    away = F.abs(2 * p[0] + 3 * p[1] + 6 * p[2] - 6) > 1e-9
    return spatial.cloud(spark, sf_dir).filter(away).select("idx", G.sidedness(normal, d, *p).cast("int").alias("side"))


@query(f"WITH {_CLOUD} SELECT idx, round(2 * x + 1, 6) AS x, round(y - x, 6) AS y, round(3 * z, 6) AS z FROM cloud")
def affine_from_corners(spark, sf_dir):
    """The affine that eight corner pairs have in common, applied to all points."""
    corners = [(i & 1, i >> 1 & 1, i >> 2 & 1) for i in range(8)]
    m = G.estimate_affine([(c, (2 * c[0] + 1, c[1] - c[0], 3 * c[2])) for c in corners])
    return spatial.rounded(locations.transform_points(spatial.cloud(spark, sf_dir), m).drop("label"), "idx").select("idx", *[(F.col(c) + 0.0).alias(c) for c in "xyz"])


# Masks and regions.

_EDGE = "edge AS (SELECT DISTINCT g.x + i AS x, g.y + j AS y, g.z + k AS z FROM mask g, (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) o(i, j, k) WHERE NOT EXISTS (SELECT 1 FROM mask h WHERE h.x = g.x + i AND h.y = g.y + j AND h.z = g.z + k))"


@query(f"WITH {spatial.GRID}, mask AS (SELECT DISTINCT x, y, z FROM grid), {_EDGE} SELECT m.x, m.y, m.z, CAST(min(abs(m.x - e.x) + abs(m.y - e.y) + abs(m.z - e.z)) AS INTEGER) AS depth FROM mask m, edge e GROUP BY ALL")
def mask_depth(spark, sf_dir):
    return components.distance_to_background(voxels.select(spatial.grid(spark, sf_dir), threshold=0.0))


@query(f"WITH {spatial.GRID}, mask AS (SELECT DISTINCT x, y, z FROM grid), {_EDGE} SELECT m.x, m.y, m.z, CAST(min((m.x - e.x) ** 2 + (m.y - e.y) ** 2 + (m.z - e.z) ** 2) AS BIGINT) AS squared FROM mask m, edge e GROUP BY ALL")
def mask_squared_distance(spark, sf_dir):
    """The weight with which places in a mask are sampled."""
    return components.squared_distance(voxels.select(spatial.grid(spark, sf_dir), threshold=0.0))


_MAPPED = "m AS (SELECT 'N' || n_nationkey AS id, n_nationkey AS volume, 'R' || n_regionkey AS up FROM nation WHERE n_nationkey IN (SELECT volume FROM grid)), s AS (SELECT id, volume FROM m UNION ALL SELECT up, volume FROM m)"


@query(f"WITH {spatial.GRID}, {_MAPPED}, v AS (SELECT DISTINCT s.id, g.x, g.y, g.z FROM s JOIN grid g USING (volume) WHERE g.x >= 5 AND g.x < 10 AND g.y >= 6 AND g.y < 9 AND g.z >= 4 AND g.z < 11) SELECT id, count(*) AS voxels, min(x) AS x0, max(x) + 1 AS x1, min(y) AS y0, max(y) + 1 AS y1, min(z) AS z0, max(z) + 1 AS z1 FROM v GROUP BY id")
def regions_in_box(spark, sf_dir):
    """Of every region, what of its mask (or, without one, its children's) lies in a box."""
    masks = spatial.grid(spark, sf_dir).select(F.concat(F.lit("N"), "volume").alias("source"), "x", "y", "z")
    sources = hierarchy.mask_sources(trees.tree(spark, sf_dir, "supplier"), masks.select(F.col("source").alias("id")))
    inside = voxels.region_in_box(sources, masks, (5, 6, 4), (10, 9, 11))
    return inside.groupBy("id").agg(F.count("*").alias("voxels"), *[f(c).alias(f"{c}{i}") for c in "xyz" for i, f in ((0, F.min), (1, lambda v: F.max(v) + 1))])


@query(f"WITH {spatial.GRID} SELECT volume, x, y, z, value FROM grid WHERE x >= 5 AND x < 10 AND y >= 6 AND y < 9 AND z >= 4 AND z < 11")
def voxel_store_box(spark, sf_dir):
    """A voxel store written by block, of which a box reads only its blocks."""
    folder = _folder(spark)
    sinks.write_voxels(spatial.grid(spark, sf_dir), folder)
    return voxels.in_box(spark.read.parquet(folder), (5, 6, 4), (10, 9, 11)).select("volume", "x", "y", "z", "value")


# Tables written and read back.


@query("SELECT p_partkey, p_name, p_size FROM part")
def csv_table(spark, sf_dir):
    folder = _folder(spark)
    sinks.write_csv(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), folder)
    return files.table(spark, folder).select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", F.col("p_size").cast("int").alias("p_size"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN s_name END AS s_name FROM supplier")
def tsv_table(spark, sf_dir):
    """Rows without any value are dropped."""
    folder = _folder(spark)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name")).alias("s_name"))
    s.union(spark.createDataFrame([(None, None)] * 5, s.schema)).write.options(header=True, sep="\t").csv(folder)
    return files.tsv(spark, folder).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name")


@query("SELECT n_nationkey AS a, n_regionkey AS b FROM nation")
def spaced_table(spark, sf_dir):
    folder = _folder(spark)
    table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").write.options(sep=" ").csv(folder)
    return files.spaced(spark, folder).select(F.col("_c0").cast("long").alias("a"), F.col("_c1").cast("long").alias("b"))


@query("SELECT n_regionkey AS element, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation GROUP BY n_regionkey")
def compound_elements(spark, sf_dir):
    """One folder per element of a compound."""
    folder = _folder(spark)
    sinks.write_elements(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("element"), "n_nationkey"), "element", folder)
    back = spark.read.option("header", True).csv(folder)
    return back.groupBy(F.col("element").cast("long").alias("element")).agg(F.count("*").alias("n"), F.sum(F.col("n_nationkey").cast("long")).alias("keys"))


@query("SELECT n_regionkey AS src, CAST(count(*) FILTER (n_nationkey % 2 = 0) AS BIGINT) AS \"0\", CAST(count(*) FILTER (n_nationkey % 2 = 1) AS BIGINT) AS \"1\" FROM nation GROUP BY n_regionkey")
def connectivity_table(spark, sf_dir):
    """A connectivity matrix as a square table."""
    folder = _folder(spark)
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("src"), (F.col("n_nationkey") % 2).cast("string").alias("dst")).agg(F.count("*").alias("value"))
    sinks.write_matrix(n, folder, ["0", "1"])
    back = spark.read.option("header", True).csv(folder)
    return back.select(*[F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(0)).alias(c) for c in ("src", "0", "1")])


@query(f"WITH {spatial.GRID} SELECT volume, x, y, z, value FROM grid")
def sparse_text_map(spark, sf_dir):
    """A sparse map as text: one line of volumes and values per place, and the places by line number."""
    folder = _folder(spark)
    g = spatial.grid(spark, sf_dir)
    lines = g.groupBy("x", "y", "z").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("volume", "value"))), lambda s: F.concat_ws(" ", s["volume"].cast("string"), s["value"].cast("string"))), " ").alias("line"))
    lines.select("x", "y", "z", "line").repartitionByRange(3, "x").sortWithinPartitions("x", "y", "z").write.option("header", False).csv(f"{folder}/both", sep="\t")
    rows = files.numbered(spark, f"{folder}/both").withColumn("v", F.split("value", "\t")).select("id", *[F.get("v", F.lit(i)).cast("int").alias(c) for i, c in enumerate("xyz")], F.get("v", F.lit(3)).alias("line"))
    rows.repartitionByRange(4, "id").sortWithinPartitions("id").select("line").write.text(f"{folder}/lines")
    return files.sparse_text(spark, f"{folder}/lines", rows.select("id", "x", "y", "z")).select("volume", "x", "y", "z", "value")


@query("SELECT CAST(n_nationkey AS VARCHAR) || '.txt' AS name, CAST(length(n_name) AS BIGINT) AS length FROM nation WHERE n_nationkey % 10 = 4")
def files_by_suffix(spark, sf_dir):
    """Files of a folder by suffix: a text file for each nation, found by the end of its name."""
    folder = _folder(spark)
    n = table(spark, sf_dir, "nation").withColumn("name", F.concat(F.col("n_nationkey").cast("string"), F.lit(".txt")))
    n.select("name", F.col("n_name").alias("value")).repartition("name").write.partitionBy("name").option("lineSep", "|").text(folder)
    found = files.search(spark, folder, ".txt").withColumn("name", F.regexp_extract("path", "name=([^/]+)/", 1))
    return files.in_folder(found, suffix="4.txt").select("name", (F.col("length") - 1).alias("length"))


# Features and regions by id.


@query("""
WITH f AS (SELECT p_partkey, md5(p_name || CAST(p_partkey AS VARCHAR)) AS id, 'cf0::Foo::' || p_brand AS compound FROM part),
w AS (SELECT id AS wanted, id AS feature_id, NULL AS error FROM f WHERE p_partkey % 2 = 0 UNION ALL SELECT 'lq0::Foo::p:parc::r:reg::' || id, id, NULL FROM f WHERE p_partkey % 2 = 1
  UNION ALL SELECT DISTINCT w.compound, f.id, NULL FROM f w JOIN f USING (compound) WHERE w.p_partkey % 3 = 0 UNION ALL SELECT 'lq0::Foo::r:reg::x', NULL, 'region without parcellation' UNION ALL SELECT 'nothing', NULL, 'unknown')
SELECT * FROM w
""")
def features_by_id(spark, sf_dir):
    """Features by their own id, by a live query's id and by a compound's."""
    p = table(spark, sf_dir, "part").select("p_partkey", ids.feature_id(F.lit(None), F.col("p_name"), F.col("p_partkey").cast("string")).alias("feature_id"), F.concat(F.lit("cf0::Foo::"), "p_brand").alias("compound_id"))
    live = ids.encode_query_context(F.lit("Foo"), ids.encode_concept(F.lit(None).cast("string"), F.lit("parc"), F.lit("reg")), F.col("feature_id"))
    odd = spark.createDataFrame([("lq0::Foo::r:reg::x",), ("nothing",)], "wanted string")
    wanted = p.select(F.when(F.col("p_partkey") % 2 == 0, F.col("feature_id")).otherwise(live).alias("wanted")).union(p.filter("p_partkey % 3 = 0").select("compound_id")).union(odd)
    return features.by_id(p.select("feature_id"), p.select("compound_id", "feature_id"), wanted)


@query("WITH t AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{t}')" for t, c, *_ in features.FEATURE_TYPES) + ") t(category, name)) SELECT category AS id, category AS line FROM t GROUP BY category UNION ALL SELECT category || '/' || name, '  ' || name FROM t")
def feature_type_tree(spark, sf_dir):
    tree = hierarchy.with_paths(features.type_tree(features.feature_types(spark)))
    return tree.select("id", hierarchy.render(F.col("depth"), F.col("name")).alias("line"))


@query(f"WITH {trees.SUPPLIERS}, v AS (SELECT id, parent, CASE WHEN id NOT LIKE 'S%' OR CAST(substr(id, 2) AS BIGINT) % 3 = 0 THEN name END AS name FROM tree) SELECT v.id, coalesce(v.name, p.name) AS name FROM v LEFT JOIN v p ON p.id = v.parent")
def names_of_own_or_parent(spark, sf_dir):
    own = ~F.col("id").startswith("S") | (F.substr("id", F.lit(2)).try_cast("long") % 3 == 0)
    return hierarchy.own_or_parent(trees.nodes(spark, sf_dir, "supplier").withColumn("name", F.when(own, F.col("name"))), "name")


@query(f"WITH {spatial.GRID} SELECT 'region ' || CAST(value AS BIGINT) AS region, count(*) AS voxels FROM grid WHERE value IN (1, 2) GROUP BY value")
def labelled_voxels(spark, sf_dir):
    """A map from a volume and its labels; voxels of other labels are background."""
    known, _ = voxels.labelled_map(spatial.grid(spark, sf_dir), spark.createDataFrame([(1, "region 1"), (2, "region 2")], "label int, region string"))
    return known.groupBy("region").agg(F.count("*").alias("voxels"))


# Registries and templates.


@query(f"WITH {spatial.GRID}, i AS (SELECT DISTINCT volume FROM grid) SELECT 'region 2' AS ancestor, volume FROM i WHERE volume = 2 UNION ALL SELECT 'all', volume FROM i WHERE volume IN (1, 3)")
def map_indices(spark, sf_dir):
    """Where a map keeps regions: a region of its own, or else those below it."""
    index = spatial.index(spatial.grid(spark, sf_dir))
    below = [("region 2", "region 2"), ("region 2", "region 5"), ("all", "region 1"), ("all", "region 3"), ("none", "nowhere")]
    return registry.indices_of(index, spark.createDataFrame(below, "ancestor string, region string")).select("ancestor", "volume")


@query("SELECT p_brand AS space_id, arg_min(p_name, p_partkey) AS variant FROM part WHERE contains(lower(p_name), 'a') GROUP BY p_brand")
def template_variants(spark, sf_dir):
    """The first template of each space whose variant's name holds a word."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("space_id"), F.col("p_name").alias("variant"), F.col("p_partkey").alias("ord"))
    return selection.template(p, "A").select("space_id", "variant")
