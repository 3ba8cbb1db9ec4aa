"""Data features and their anchors: suppliers stand for features anchored at nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratlas.operators import assignment, features, hierarchy, locations, selection
from stratlas.plans.registry import query, table
from stratlas.plans.spatial import _MEET, BOXES, boxes, cloud
from stratlas.plans.trees import tree

TYPES = ["StreamlineCounts", "ReceptorDensityProfile", "GeneExpressions", "FunctionalConnectivity"]
FEATURES = (
    "f AS (SELECT 'F' || s_suppkey AS feature_id, list_extract(['StreamlineCounts', 'ReceptorDensityProfile', 'GeneExpressions', 'FunctionalConnectivity'], s_suppkey % 4 + 1) AS type, 'm' || s_suppkey % 2 AS modality, 'c' || s_suppkey % 3 AS cohort, 'p' || s_suppkey % 5 AS paradigm, s_suppkey AS ord, 'N' || s_nationkey AS region_id, s_nationkey AS nation, s_acctbal AS bal FROM supplier)"
)
CODE = "CASE WHEN region_id = concept THEN 1 WHEN starts_with(concept, 'R') THEN 4 ELSE 5 END"
MATCHES = f"{FEATURES}, c(concept) AS (VALUES ('R1'), ('N3'), ('N7'), ('S2')), m AS (SELECT feature_id, concept, {CODE} AS code FROM f, c LEFT JOIN supplier s ON concept = 'S' || s.s_suppkey WHERE region_id = concept OR concept = (SELECT 'R' || n_regionkey FROM nation WHERE 'N' || n_nationkey = region_id) OR region_id = 'N' || s.s_nationkey)"


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    named = lambda c, n: F.concat(F.lit(c), k % n)
    return s.select(
        F.concat(F.lit("F"), k).alias("feature_id"), F.get(F.lit(TYPES), (k % 4).cast("int")).alias("type"), named("m", 2).alias("modality"), named("c", 3).alias("cohort"), named("p", 5).alias("paradigm"), k.alias("ord"), F.concat(F.lit("N"), "s_nationkey").alias("region_id"), F.col("s_acctbal").alias("bal")
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    closure = hierarchy.closure(tree(spark, sf_dir, "supplier"))
    anchors = catalogue(spark, sf_dir).select("feature_id", "region_id", F.lit(1).alias("code"))
    return features.match_regions(anchors, closure, spark.createDataFrame([("R1",), ("N3",), ("N7",), ("S2",)], "region_id string"))


@query(f"WITH {MATCHES} SELECT feature_id, concept, CAST(code AS INTEGER) AS code FROM m")
def match_features(spark, sf_dir):
    return matches(spark, sf_dir)


@query(f"WITH {MATCHES} SELECT feature_id, type, CAST(min(code) AS INTEGER) AS code FROM m JOIN f USING (feature_id) WHERE type IN ('StreamlineCounts', 'FunctionalConnectivity') GROUP BY feature_id, type")
def get_features(spark, sf_dir):
    kinds = features.parse_type(features.feature_types(spark), "connectivity")
    return features.get(catalogue(spark, sf_dir), matches(spark, sf_dir), kinds).select("feature_id", "type", "code")


@query(f"WITH {BOXES}, w AS (SELECT label AS concept, {', '.join(f'min({c}) AS {c}0, max({c}) AS {c}1' for c in 'xyz')} FROM cloud GROUP BY label) SELECT b.box AS feature_id, w.concept, CAST(CASE WHEN {' AND '.join(f'b.{c}0 >= w.{c}0 AND b.{c}1 <= w.{c}1' for c in 'xyz')} THEN 4 WHEN {' AND '.join(f'w.{c}0 >= b.{c}0 AND w.{c}1 <= b.{c}1' for c in 'xyz')} THEN 5 ELSE 6 END AS INTEGER) AS code FROM boxes b JOIN w ON {_MEET.replace('a.', 'b.#').replace('b.', 'w.').replace('w.#', 'b.')}")
def match_feature_boxes(spark, sf_dir):
    wide = locations.bounding_box(cloud(spark, sf_dir), "label").withColumnRenamed("label", "concept")
    return features.match_boxes(boxes(spark, sf_dir).withColumnRenamed("box", "feature_id"), wide)


@query("""
WITH a AS (SELECT 'F' || s_suppkey AS feature_id, CASE WHEN s_suppkey % 3 = 0 THEN 'alias ' || s_nationkey % 5 ELSE 'NATION_' || s_nationkey END AS spec, CASE WHEN s_suppkey % 2 = 0 THEN 'human' ELSE 'rat' END AS species FROM supplier),
l(spec, species, alias, code) AS (VALUES ('alias 0', 'human', 'NATION_3', 2), ('alias 0', 'human', 'NATION_4', 7), ('alias 1', 'rat', 'NATION_5', 2))
SELECT feature_id, 'N' || n_nationkey AS region_id, 1 AS code FROM a JOIN nation ON n_name = spec UNION ALL SELECT feature_id, 'N' || n_nationkey, code FROM a JOIN l USING (spec, species) JOIN nation ON n_name = alias
""")
def resolve_anchors(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    a = s.select(F.concat(F.lit("F"), "s_suppkey").alias("feature_id"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("alias "), F.col("s_nationkey") % 5)).otherwise(F.concat(F.lit("NATION_"), "s_nationkey")).alias("region_spec"), F.when(F.col("s_suppkey") % 2 == 0, "human").otherwise("rat").alias("species"))
    aliases = spark.createDataFrame([("alias 0", "human", "NATION_3", 2), ("alias 0", "human", "NATION_4", 7), ("alias 1", "rat", "NATION_5", 2)], "region_spec string, species string, alias string, code int")
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("N"), "n_nationkey").alias("region_id"))
    return features.resolve_aliases(a, aliases, names)


@query(f"WITH {FEATURES} SELECT feature_id, min(bal) AS bal FROM (SELECT feature_id, bal FROM f WHERE ord < 60 UNION ALL SELECT feature_id, 1e9 FROM f WHERE ord >= 60) GROUP BY feature_id")
def with_live_features(spark, sf_dir):
    f = catalogue(spark, sf_dir).select("feature_id", "bal")
    listed = f.filter(F.substr("feature_id", F.lit(2)).cast("long") < 60)
    return features.with_live(listed, f.withColumn("bal", F.lit(1e9)))


@query(f"""
WITH {FEATURES}, k AS (SELECT *, CASE WHEN type <> 'GeneExpressions' THEN modality END AS km, CASE WHEN type IN ('StreamlineCounts', 'FunctionalConnectivity') THEN cohort END AS kc, CASE WHEN type = 'FunctionalConnectivity' THEN paradigm END AS kp, CASE WHEN type = 'GeneExpressions' THEN feature_id END AS alone FROM f)
SELECT type, km AS k_modality, kc AS k_cohort, kp AS k_paradigm, count(*) AS elements, array_to_string(list_sort(list(feature_id)), ',') AS feature_ids, count(*) > 1 AS compound FROM k GROUP BY type, km, kc, kp, alone
""")
def compound_features(spark, sf_dir):
    got = features.compounds(catalogue(spark, sf_dir), features.feature_types(spark))
    return got.select("type", "k_modality", "k_cohort", "k_paradigm", "elements", F.array_join("feature_ids", ",").alias("feature_ids"), "compound")


@query(f"WITH {FEATURES}, b AS (SELECT type AS g, feature_id, region_id, CASE WHEN type = 'GeneExpressions' AND ord % 8 = 2 THEN 'rat' ELSE 'human' END AS species, ord * 1.0 AS lo, ord + 2.0 AS hi FROM f) SELECT g, CASE WHEN count(DISTINCT species) = 1 THEN min(species) END AS species, array_to_string(list_sort(list(DISTINCT region_id)), ',') AS regions, CAST(min(lo) AS DOUBLE) AS x0, CAST(max(hi) AS DOUBLE) AS z1 FROM b GROUP BY g")
def merged_anchors(spark, sf_dir):
    f = catalogue(spark, sf_dir)
    species = F.when((F.col("type") == "GeneExpressions") & (F.col("ord") % 8 == 2), "rat").otherwise("human")
    a = f.select("feature_id", "region_id", species.alias("species"), *[F.col("ord").cast("double").alias(c) for c in locations.LOW], *[(F.col("ord") + 2.0).alias(c) for c in locations.HIGH])
    got = features.merge_anchors(a, f.select("feature_id", F.col("type").alias("group")))
    return got.select(F.col("group").alias("g"), "species", F.array_join("regions", ",").alias("regions"), "x0", "z1")


@query(f"WITH {FEATURES} SELECT type, string_agg(DISTINCT cohort, '; ' ORDER BY cohort) AS cohort FROM f GROUP BY type")
def rolled_up_licences(spark, sf_dir):
    return features.roll_up(catalogue(spark, sf_dir), "type", "cohort")


@query("WITH v AS (SELECT o_custkey AS dataset, o_orderkey AS ord, o_orderstatus AS id, o_orderpriority AS name FROM orders) SELECT dataset, id, arg_max(name, ord) AS name FROM v GROUP BY dataset, id")
def latest_contributors(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dataset"), F.col("o_orderkey").alias("ord"), F.array(F.struct(F.col("o_orderstatus").alias("id"), F.col("o_orderpriority").alias("name"))).alias("contributors"))
    return features.latest_contributors(o)


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END || ' (' || p_brand || ')' AS name, CASE WHEN p_size % 3 = 0 THEN 'http://x/' || p_name ELSE 'https://doi.org/' || p_name END AS url FROM part")
def dataset_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    full = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("")
    ref = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("http://x/"), "p_name")).otherwise(F.col("p_name"))
    return p.select("p_partkey", features.display_name(full, F.array(F.lit(""), F.col("p_type")), F.col("p_brand")).alias("name"), features.reference_url(ref).alias("url"))


@query("SELECT p_partkey, CAST(CASE p_size % 7 + 1 WHEN 4 THEN 5 WHEN 5 THEN 4 ELSE p_size % 7 + 1 END AS INTEGER) AS inverse, p_name || ' ' || list_extract(['coincides with', 'approximates to', 'is another version of', 'is contained in', 'contains', 'overlaps with', 'is homologous to'], p_size % 7 + 1) || ' ' || p_type AS sentence FROM part")
def qualifications(spark, sf_dir):
    code = (F.col("p_size") % 7 + 1).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", assignment.invert(code).alias("inverse"), assignment.describe(F.col("p_name"), code, F.col("p_type")).alias("sentence"))


_SCALES = "s AS (SELECT p_partkey % 50 AS volume_id, p_size % 4 AS scale, 0.02 * power(2, p_size % 4) AS res, 8192 // power(2, p_size % 4) AS n FROM part GROUP BY ALL)"


@query(f"WITH {_SCALES}, w AS (SELECT volume_id, max(scale) FILTER (res <= 0.05) AS wished FROM s GROUP BY volume_id) SELECT s.volume_id, CAST(wished AS INTEGER) AS wished, CAST(min(scale) FILTER (scale >= wished AND n * n * n <= 3e10) AS INTEGER) AS scale FROM s JOIN w USING (volume_id) GROUP BY 1, 2")
def select_scales(spark, sf_dir):
    k = F.col("p_size") % 4
    res, n = 0.02 * F.pow(F.lit(2.0), k), F.floor(8192 / F.pow(F.lit(2.0), k))
    s = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("volume_id"), k.cast("int").alias("scale"), *[res.alias(f"res_{a}") for a in "xyz"], *[n.alias(f"n_{a}") for a in "xyz"], F.lit(1).alias("item_bytes")).distinct()
    return selection.select_scales(s, 0.05, max_bytes=3e10).select("volume_id", "wished", "scale")


@query("WITH h AS (SELECT DISTINCT p_brand AS map_id, p_name AS region FROM part), m AS (SELECT p_brand AS map_id, min(p_partkey) AS ord FROM part GROUP BY p_brand) SELECT region, arg_min(map_id, ord) AS map_id FROM h JOIN m USING (map_id) GROUP BY region")
def regional_maps(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("map_id"), F.col("p_name").alias("region"), "p_partkey")
    return selection.regional_maps(p, p.groupBy("map_id").agg(F.min("p_partkey").alias("ord")), p)


@query("SELECT DISTINCT p_brand AS map_id, p_size AS label, CAST(p_size AS INTEGER) AS r, CAST(p_size % 3 AS INTEGER) AS g, 7 AS b FROM part WHERE p_size % 4 > 0")
def map_colours(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    index = p.select(F.col("p_brand").alias("map_id"), F.col("p_size").alias("label"), F.col("p_partkey").alias("region"))
    colour = F.when(F.col("p_size") % 4 > 0, F.struct(F.col("p_size").alias("r"), (F.col("p_size") % 3).alias("g"), F.lit(7).alias("b")))
    return selection.colormap(index, p.select(F.col("p_partkey").alias("region"), colour.alias("rgb")))


@query("SELECT p_name AS region, 'dataset/' || p_partkey AS dataset_id, p_type AS name, CASE WHEN p_size % 2 = 0 THEN 'v' || p_size END AS version FROM part WHERE p_size % 3 > 0 AND p_type <> 'PROMO' AND p_brand <> 'Brand#13'")
def listed_datasets(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.when(F.col("p_size") % 2 == 0, F.concat("p_type", F.lit(" (v"), "p_size", F.lit(")"))).otherwise(F.col("p_type"))
    one = F.struct(F.concat(F.when(F.col("p_size") % 3 > 0, "dataset/").otherwise("other/"), "p_partkey").alias("id"), name.alias("name"), F.col("p_brand").alias("species"))
    regions = p.select(F.lit(None).cast("string").alias("alias"), F.col("p_name").alias("name"), F.array(one).alias("datasets"))
    known = p.select(F.col("p_brand").alias("species")).distinct().filter("species <> 'Brand#13'")
    return selection.listed_datasets(regions, known, blocked=("promo",))
