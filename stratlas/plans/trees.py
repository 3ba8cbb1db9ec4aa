"""Names, identifiers, registries and hierarchies; regions, nations and customers or suppliers stand for a region tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratlas.functions import ids, names
from stratlas.operators import hierarchy, registry
from stratlas.plans.registry import query, table

AREA = "'Area ' || p_brand || ' (' || p_name || ') left hemisphere'"


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    return p.withColumn("name", F.concat(F.lit("Area "), "p_brand", F.lit(" ("), "p_name", F.lit(") left hemisphere")))


def _tree(leaf: str, key: str) -> str:
    c = leaf[0]
    return f"tree AS (SELECT 'R' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent, r_name AS name FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name FROM nation UNION ALL SELECT '{c.upper()}' || {key}, 'N' || {c}_nationkey, {c}_name FROM {leaf})"


_PATHS = "p AS (SELECT id, parent, name, 0 AS depth, [id] AS path FROM tree WHERE parent IS NULL UNION ALL SELECT t.id, t.parent, t.name, p.depth + 1, list_append(p.path, t.id) FROM tree t JOIN p ON t.parent = p.id)"
CUSTOMERS, SUPPLIERS = _tree("customer", "c_custkey"), _tree("supplier", "s_suppkey")


def nodes(spark: SparkSession, sf_dir: str, leaf: str = "customer") -> DataFrame:
    key = lambda c, k: F.concat(F.lit(c), F.col(k).cast("string"))
    r = table(spark, sf_dir, "region").select(key("R", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    n = table(spark, sf_dir, "nation").select(key("N", "n_nationkey"), key("R", "n_regionkey"), "n_name")
    c = leaf[0]
    last = table(spark, sf_dir, leaf).select(key(c.upper(), f"{c}_{leaf[:4]}key"), key("N", f"{c}_nationkey"), f"{c}_name")
    return r.union(n).union(last)


def tree(spark: SparkSession, sf_dir: str, leaf: str = "customer") -> DataFrame:
    return hierarchy.with_paths(nodes(spark, sf_dir, leaf))


@query(f"""SELECT p_partkey, regexp_replace(trim(upper(regexp_replace({AREA}, '[^\\p{{L}}\\p{{N}}]', ' ', 'g'))), ' +', '_', 'g') AS key, trim(regexp_replace(replace(replace({AREA}, 'hemisphere', ''), ' -', ''), ' +', ' ', 'g')) AS clear, regexp_replace(md5({AREA}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') AS uuid FROM part""")
def name_keys(spark, sf_dir):
    a, n = areas(spark, sf_dir), F.col("name")
    return a.select("p_partkey", names.create_key(n).alias("key"), names.clear_name(n).alias("clear"), names.uuid_of(n).alias("uuid"))


@query("SELECT p_partkey, CAST('0x' || substr(md5(p_name), 1, 2) AS INTEGER) AS r, CAST('0x' || substr(md5(p_name), 3, 2) AS INTEGER) AS g, CAST('0x' || substr(md5(p_name), 5, 2) AS INTEGER) AS b FROM part")
def hex_colours(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", names.rgb(F.concat(F.lit("#"), F.substring(F.md5(F.col("p_name").cast("binary")), 1, 6))).alias("c")).select("p_partkey", "c.*")


@query("SELECT DISTINCT p_type, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || 'Part' AS camel, upper(regexp_replace(p_name, '\\s+', '_', 'g')) AS species, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || ' Part' AS readable FROM part")
def class_names(spark, sf_dir):
    camel = names.snake_to_camel(F.concat(F.col("p_type"), F.lit("_part")))
    return table(spark, sf_dir, "part").select("p_type", camel.alias("camel"), names.species_key(F.col("p_name")).alias("species"), names.readable_class_name(camel).alias("readable")).distinct()


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, -p_size - 0.5::DOUBLE AS y, 3.0::DOUBLE AS z FROM part")
def parse_points(spark, sf_dir):
    s = F.concat(F.col("p_size"), F.lit("mm, -"), F.col("p_size"), F.lit(".5 mm, 3mm"))
    p = table(spark, sf_dir, "part").select("p_partkey", names.parse_point(s).alias("p"))
    return p.select("p_partkey", *[F.get("p", F.lit(i)).alias(c) for i, c in enumerate("xyz")])


_HAVE = "regexp_extract_all(lower(p_name || ' ' || p_type || ' v' || p_size), '[a-zA-Z0-9.\\-]+')"


@query(f"SELECT p_partkey, list_contains({_HAVE}, 'widget') AND (list_contains({_HAVE}, '24') OR list_contains({_HAVE}, 'v24')) OR p_partkey = 7 AS matched FROM part")
def region_words(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("name", F.concat_ws(" ", "p_name", "p_type", F.concat(F.lit("v"), "p_size")))
    both = names.region_matches(F.lit("Widget, 24"), F.col("p_type"), F.col("p_brand"), F.col("name")) | names.region_matches(F.lit(" 7 "), F.col("p_partkey").cast("string"), F.col("p_brand"), F.lit("-"))
    return p.select("p_partkey", both.alias("matched"))


@query("SELECT p_partkey FROM part WHERE (contains(replace(p_name, ' ', ''), 'bolt') AND contains(replace(p_name, ' ', ''), 'l')) OR p_brand = 'bolt-L'")
def concept_words(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.filter(names.concept_matches(F.lit("bolt-L"), F.col("p_brand"), F.col("p_type"), F.col("p_name"))).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)^S.*R$') OR regexp_matches(p_type, '(?i)^S.*R$')")
def region_regex(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(names.regex_matches("^S.*R$", F.col("p_name"), F.col("p_type"), "iu")).select("p_partkey")


@query("SELECT p_name, count(*) AS n, CAST(sum(len(p_name || '; ' || p_type || ' (a, b)') - 8) AS BIGINT) AS chars FROM part GROUP BY p_name")
def group_specs(spark, sf_dir):
    spec = F.concat(F.lit("Group: "), "p_name", F.lit(", "), "p_type", F.lit(" (a, b)"))
    p = table(spark, sf_dir, "part").withColumn("m", names.group_members(spec)).filter(F.size("m") == 2)
    return p.groupBy("p_name").agg(F.count("*").alias("n"), F.sum(F.char_length(F.get("m", F.lit(0))) + F.char_length(F.get("m", F.lit(1))) + 2 - 8).cast("long").alias("chars"))


@query(f"WITH RECURSIVE {CUSTOMERS}, {_PATHS} SELECT id, name, CAST(depth AS INTEGER) AS depth, array_to_string(path, '/') AS path FROM p")
def tree_paths(spark, sf_dir):
    return tree(spark, sf_dir).select("id", "name", "depth", F.array_join("path", "/").alias("path"))


@query(f"WITH RECURSIVE {CUSTOMERS}, {_PATHS}, c AS (SELECT unnest(path) AS ancestor, id, depth FROM p) SELECT ancestor, count(*) AS nodes, CAST(max(c.depth - p.depth) AS INTEGER) AS height FROM c JOIN p ON p.id = ancestor GROUP BY ancestor")
def tree_closure(spark, sf_dir):
    return hierarchy.closure(tree(spark, sf_dir)).groupBy("ancestor").agg(F.count("*").alias("nodes"), F.max("distance").alias("height"))


@query(f"WITH RECURSIVE {CUSTOMERS}, {_PATHS} SELECT id, CAST(row_number() OVER (PARTITION BY path[1] ORDER BY path) - 1 AS INTEGER) AS preorder, repeat('  ', depth) || name AS line FROM p")
def tree_preorder(spark, sf_dir):
    return hierarchy.preorder(tree(spark, sf_dir)).select("id", "preorder", hierarchy.render(F.col("depth"), F.col("name")).alias("line"))


@query(f"WITH RECURSIVE {CUSTOMERS}, {_PATHS} SELECT id, CAST(depth - 1 AS INTEGER) AS depth FROM p WHERE list_contains(path, 'N3')")
def tree_subtree(spark, sf_dir):
    return hierarchy.subtree(tree(spark, sf_dir), "N3").select("id", "depth")


_HIT = "hit AS (SELECT id, parent FROM tree WHERE contains(name, 'A')), kept AS (SELECT id, parent FROM hit h WHERE EXISTS (SELECT 1 FROM hit c WHERE c.parent = h.id) OR h.parent IS NULL OR h.parent NOT IN (SELECT id FROM hit))"


@query(f"WITH {SUPPLIERS}, {_HIT} SELECT id FROM kept")
def find_regions(spark, sf_dir):
    return hierarchy.find(tree(spark, sf_dir, "supplier"), F.contains("name", F.lit("A")), filter_children=True).select("id")


@query(f"WITH {SUPPLIERS}, {_HIT}, full_ AS (SELECT parent AS id FROM tree t WHERE parent IS NOT NULL GROUP BY parent HAVING bool_and(id IN (SELECT id FROM kept))), b AS (SELECT DISTINCT t.id, t.parent FROM tree t WHERE t.id IN (SELECT id FROM kept UNION SELECT id FROM full_)) SELECT id FROM b WHERE parent IS NULL OR parent NOT IN (SELECT id FROM b)")
def find_topmost_regions(spark, sf_dir):
    return hierarchy.find(tree(spark, sf_dir, "supplier"), F.contains("name", F.lit("A")), filter_children=True, find_topmost=True).select("id")


@query()
def find_ranked_regions(spark, sf_dir):
    t = tree(spark, sf_dir, "supplier")
    return hierarchy.ranked(hierarchy.find(t, names.region_matches(F.lit("nation"), F.col("id"), F.col("id"), F.col("name"))), "nation 12").select("id", "name", "similarity")


_SPECS = "s(spec) AS (VALUES ('ASIA'), ('nation 3'), ('N4'), ('nation'), ('nowhere'))"


@query(f"""
WITH {SUPPLIERS}, {_SPECS}, w AS (SELECT s.spec, t.id, t.parent, t.name, list_has_all(regexp_extract_all(lower(t.name), '[a-z0-9.\\-]+'), regexp_extract_all(lower(s.spec), '[a-z0-9.\\-]+')) OR lower(s.spec) IN (lower(t.id), lower(t.name)) AS m FROM s, tree t),
e AS (SELECT spec, min(id) AS id FROM w WHERE spec = name OR spec = id GROUP BY spec), h AS (SELECT * FROM w WHERE m),
k AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h u WHERE u.spec = h.spec AND u.id = h.parent) OR EXISTS (SELECT 1 FROM h c WHERE c.spec = h.spec AND c.parent = h.id)),
c AS (SELECT spec, count(*) AS n, min(id) AS id FROM k GROUP BY spec)
SELECT s.spec, CASE WHEN e.id IS NOT NULL THEN 1 ELSE coalesce(c.n, 0) END AS matches, coalesce(e.id, CASE WHEN c.n = 1 THEN c.id END) AS id FROM s LEFT JOIN e USING (spec) LEFT JOIN c USING (spec)
""")
def resolve_regions(spark, sf_dir):
    specs = spark.createDataFrame([(s,) for s in ("ASIA", "nation 3", "N4", "nation", "nowhere")], "spec string")
    match = names.region_matches(F.col("spec"), F.col("id"), F.col("id"), F.col("name"))
    return hierarchy.resolve(tree(spark, sf_dir, "supplier"), specs, match, key="id")


@query("""
WITH own AS (SELECT 'a' AS space, s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'b', s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 3000),
n AS (SELECT space, s_nationkey AS k, count(*) AS c FROM own GROUP BY ALL), t AS (SELECT s_nationkey AS k, count(*) AS c FROM supplier GROUP BY ALL),
full_n AS (SELECT n.space, n.k FROM n JOIN t USING (k, c)), r AS (SELECT space, n_regionkey AS k, count(*) AS c FROM full_n JOIN nation ON n_nationkey = k GROUP BY ALL), tr AS (SELECT n_regionkey AS k, count(*) AS c FROM nation GROUP BY ALL)
SELECT space, 'S' || s_suppkey AS id FROM own UNION ALL SELECT space, 'N' || k FROM full_n UNION ALL SELECT r.space, 'R' || r.k FROM r JOIN tr USING (k, c)
""")
def mapped_regions(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    own = s.filter("s_acctbal > 0").select(F.lit("a").alias("space"), F.concat(F.lit("S"), "s_suppkey").alias("id")).union(s.filter("s_acctbal > 3000").select(F.lit("b"), F.concat(F.lit("S"), "s_suppkey")))
    return hierarchy.covered(nodes(spark, sf_dir, "supplier"), own, "space")


@query("WITH v AS (SELECT p_partkey, p_name, 'v' || replace(p_brand, 'Brand#', '') || '.' || p_size AS version, [CAST(replace(p_brand, 'Brand#', '') AS BIGINT), CAST(p_size AS BIGINT)] AS k FROM part) SELECT p_name, version, lag(version) OVER w AS previous, lead(version) OVER w AS next, lead(version) OVER w IS NULL AS newest FROM v WINDOW w AS (PARTITION BY p_name ORDER BY k, version)")
def version_chain(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_name", F.concat(F.lit("v"), F.replace("p_brand", F.lit("Brand#"), F.lit("")), F.lit("."), "p_size").alias("version"))
    return hierarchy.version_chain(p, "p_name", "version")


@query("WITH r AS (SELECT 'N' || n_nationkey AS a, 'R' || n_regionkey AS b, n_nationkey % 3 AS code FROM nation) SELECT DISTINCT id, related, CAST(code AS INTEGER) AS code FROM (SELECT a AS id, b AS related, code FROM r UNION ALL SELECT b, a, code FROM r) WHERE id IN ('N2', 'N4', 'R1')")
def related_regions(spark, sf_dir):
    r = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("a"), F.concat(F.lit("R"), "n_regionkey").alias("b"), (F.col("n_nationkey") % 3).alias("code"))
    return hierarchy.translated(r, spark.createDataFrame([("N2",), ("N4",), ("R1",)], "id string"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.col("n_name").alias("key"), F.lower("n_name").alias("name"), F.col("n_nationkey").alias("ord"))


@query("SELECT 'N' || n_nationkey AS id FROM nation WHERE contains(lower(n_name), 'nation') AND contains(lower(n_name), '1')")
def registry_find(spark, sf_dir):
    return registry.find(_items(spark, sf_dir), "Nation 1").select("id")


@query("SELECT 'N' || n_nationkey AS id FROM nation WHERE n_nationkey = 12")
def registry_position(spark, sf_dir):
    return registry.find(_items(spark, sf_dir), "12").select("id")


@query("SELECT 'N' || n_nationkey AS id FROM nation WHERE contains(n_name, 'NATION') AND contains(n_name, '1') ORDER BY n_name DESC LIMIT 1")
def registry_get(spark, sf_dir):
    return registry.get(_items(spark, sf_dir), "Nation 1", F.col("key")).select("id")


@query("SELECT p_name AS key, CAST(levenshtein(p_name, 'cold wodget') AS INTEGER) AS distance FROM (SELECT DISTINCT p_name FROM part) ORDER BY 2, 1 LIMIT 3")
def did_you_mean(spark, sf_dir):
    return registry.closest(table(spark, sf_dir, "part").select(F.col("p_name").alias("key")).distinct(), "cold wodget")


@query("SELECT 'N' || n_nationkey AS id FROM nation WHERE n_nationkey <> 5")
def registry_without(spark, sf_dir):
    return registry.without(_items(spark, sf_dir), "N5").select("id")


_INDEX = "i AS (SELECT p_brand AS map_id, p_size % 3 AS volume, CASE WHEN p_brand < 'Brand#2' THEN p_size % 5 WHEN p_brand < 'Brand#3' THEN nullif(p_size % 5, 0) END AS label, CAST(NULL AS VARCHAR) AS fragment FROM part)"


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("p_brand") < "Brand#2", F.col("p_size") % 5).when(F.col("p_brand") < "Brand#3", F.nullif(F.col("p_size") % 5, F.lit(0)))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("map_id"), (F.col("p_size") % 3).alias("volume"), label.alias("label"), F.lit(None).cast("string").alias("fragment"))


@query(f"WITH {_INDEX} SELECT map_id, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ','), '') AS labels, CASE WHEN count(label) = 0 THEN 'STATISTICAL' WHEN count(label) = count(*) THEN 'LABELLED' END AS maptype FROM i GROUP BY map_id")
def map_types(spark, sf_dir):
    return registry.map_types(_index(spark, sf_dir)).select("map_id", F.array_join("labels", ",").alias("labels"), "maptype")


@query(f"WITH {_INDEX} SELECT map_id, volume, label, count(*) AS regions FROM i GROUP BY map_id, volume, label HAVING count(*) > 1")
def duplicate_indices(spark, sf_dir):
    return registry.duplicate_indices(_index(spark, sf_dir)).drop("fragment")


@query("SELECT p_type, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n = 1")
def first_of_each(spark, sf_dir):
    return registry.first_per(table(spark, sf_dir, "part"), ["p_type"], F.desc("p_retailprice"), "p_partkey").select("p_type", "p_partkey", "p_name")


_D = ids.DIGITS
_N = "(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * event_id * 7919)"


@query(f"SELECT event_id, coalesce(nullif(ltrim({' || '.join(f'substr($${_D}$$, CAST(((abs({_N}) >> {6 * k}) & 63) + 1 AS INTEGER), 1)' for k in range(10, -1, -1))}, '0'), ''), '0') || CASE WHEN {_N} < 0 THEN '~' ELSE '' END AS encoded, {_N} AS decoded FROM events")
def encoded_numbers(spark, sf_dir):
    n = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1) * F.col("event_id") * 7919
    e = table(spark, sf_dir, "events").select("event_id", ids.encode_number(n).alias("encoded"))
    return e.withColumn("decoded", ids.decode_number(F.col("encoded")))


@query("SELECT event_id, 'atlas/space' AS space, round((event_id * 1000 - 5000 * 500) / 1e6, 6) AS x0, round((event_id * 1000 + 5000 * 500) / 1e6, 6) AS x1 FROM events")
def viewer_links(spark, sf_dir):
    c = lambda s: F.lit(s)
    e = table(spark, sf_dir, "events").select("event_id", ids.encode_view("https://viewer/", c("a"), c("atlas/space"), c("p"), F.col("event_id") / 1000.0 + 1e-9, c(0.0), c(0.0), F.lit(5000).cast("long"), F.lit(100000).cast("long")).alias("url"))
    return e.select("event_id", ids.decode_view(F.col("url")).alias("v")).select("event_id", "v.space", F.round("v.x0", 6).alias("x0"), F.round("v.x1", 6).alias("x1"))


_CONTEXTS = (
    "lq0::Foo::p:parc::r:reg::fid",
    "lq0::Foo::s:space::fid",
    "lq1::Foo::s:space::fid",
    "lq0::Foo::r:reg::fid",
    "lq0::Foo::s:space::p:parc::fid",
    "lq0::Foo::fid",
    "lq0::fid",
)


@query("SELECT * FROM (VALUES ('lq0::Foo::p:parc::r:reg::fid', 'parc', 'reg', NULL), ('lq0::Foo::s:space::fid', NULL, NULL, NULL), ('lq1::Foo::s:space::fid', NULL, NULL, 'version'), ('lq0::Foo::r:reg::fid', NULL, 'reg', 'region without parcellation'), ('lq0::Foo::s:space::p:parc::fid', 'parc', NULL, 'conflicting'), ('lq0::Foo::fid', NULL, NULL, 'no concept'), ('lq0::fid', NULL, NULL, 'no id')) t(context, parcellation, region, error)")
def query_contexts(spark, sf_dir):
    x = spark.createDataFrame([(c,) for c in _CONTEXTS], "context string").withColumn("d", ids.decode_query_context(F.col("context")))
    return x.select("context", "d.parcellation", "d.region", "d.error")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN md5(p_name || p_type) ELSE p_brand || '--' || md5(p_name || p_type) END AS id, 'cf0::Foo::p:' || p_brand || '::' || p_type || '::' || md5(p_name) AS compound, 'lq0::Foo::p:' || p_brand || '::r:' || p_name || '::x' AS live FROM part")
def feature_ids(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    concept = ids.encode_concept(F.lit(None).cast("string"), F.col("p_brand"), F.col("p_name"))
    return p.select(
        "p_partkey",
        ids.feature_id(F.when(F.col("p_size") % 2 != 0, F.col("p_brand")), F.col("p_name"), F.col("p_type")).alias("id"),
        ids.compound_id(F.lit("Foo"), F.concat(F.lit("p:"), "p_brand"), F.col("p_type"), F.col("p_name")).alias("compound"),
        ids.encode_query_context(F.lit("Foo"), concept, F.lit("x")).alias("live"),
    )

