"""Measurements per region: trade between nations stands for connectivity, events for recordings, line items for cells and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratlas.operators import tabular
from stratlas.plans.registry import query, table

CONN = "conn AS (SELECT year(o_orderdate) AS subject, c_nationkey AS src, s_nationkey AS dst, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"
TOPS = "tops(layer, top) AS (VALUES (1, 0.0), (2, 0.105), (3, 0.205), (4, 0.355), (5, 0.405), (6, 0.555), (7, 0.705))"


def conn(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("subject"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    x = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return x.groupBy("subject", "src", "dst").agg(F.sum("l_quantity").alias("value"))


def _tops(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, 0.0), (2, 0.105), (3, 0.205), (4, 0.355), (5, 0.405), (6, 0.555), (7, 0.705)], "layer int, top double")


@query(f"WITH {CONN} SELECT src, dst, round(avg(value), 9) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS n FROM conn GROUP BY src, dst")
def mean_connectivity(spark, sf_dir):
    got = tabular.mean_std(conn(spark, sf_dir), ["src", "dst"])
    return got.select("src", "dst", F.round("mean", 9).alias("mean"), F.round("std", 6).alias("std"), "n")


@query(f"WITH {CONN}, m AS (SELECT src, dst, round(avg(value), 9) AS value FROM conn GROUP BY src, dst) SELECT src AS region, value FROM m WHERE dst = 3 AND value > 5 ORDER BY value DESC, src LIMIT 10")
def connectivity_profile(spark, sf_dir):
    mean = tabular.mean_std(conn(spark, sf_dir), ["src", "dst"]).select("src", "dst", F.round("mean", 9).alias("value"))
    return tabular.profile(mean, 3, minimum=5, rows=10)


@query(f"WITH {CONN}, m AS (SELECT src, sum(value) AS value FROM conn GROUP BY src) SELECT src, value, round(value / (SELECT max(value) FROM m), 9) AS relative FROM m")
def relative_strength(spark, sf_dir):
    x = tabular.relative(conn(spark, sf_dir).groupBy("src").agg(F.sum("value").alias("value")))
    return x.select("src", "value", F.round("relative", 9).alias("relative"))


@query(f"WITH {CONN} SELECT a.n_name AS src, b.n_name AS dst, sum(value) AS value FROM conn JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey GROUP BY 1, 2")
def named_connectivity(spark, sf_dir):
    labels = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("region"))
    total = conn(spark, sf_dir).groupBy("src", "dst").agg(F.sum("value").alias("value"))
    return tabular.label_positions(total, labels, "src", "dst").select("src", "dst", "value")


@query("SELECT p_size % 10 AS pos, round(avg(s_acctbal), 9) AS x, round(avg(-s_acctbal), 9) AS y, round(avg(s_nationkey), 9) AS z FROM part JOIN supplier ON p_partkey % 100 = s_suppkey GROUP BY 1")
def label_centroids(spark, sf_dir):
    labels = table(spark, sf_dir, "part").select((F.col("p_size") % 10).alias("pos"), (F.col("p_partkey") % 100).alias("region"))
    at = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("region"), F.col("s_acctbal").alias("x"), (-F.col("s_acctbal")).alias("y"), F.col("s_nationkey").cast("double").alias("z"))
    got = tabular.region_centroids(labels, at)
    return got.select("pos", *[F.round(c, 9).alias(c) for c in "xyz"])


@query("SELECT p_partkey, p_name || repeat('*', CAST(row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) - 1 AS INTEGER)) AS unique_label FROM part")
def unique_labels(spark, sf_dir):
    return tabular.unique_labels(table(spark, sf_dir, "part"), "p_name", "p_partkey", "p_brand").select("p_partkey", "unique_label")


@query("SELECT event_id, round((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * 0.72::DOUBLE, 9) AS t FROM events")
def time_axis(spark, sf_dir):
    return tabular.time_axis(table(spark, sf_dir, "events"), 0.72, "event_id", "user_id").select("event_id", F.round("t", 9).alias("t"))


_BOLD = "bold AS (SELECT user_id AS subject, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS t, event_type AS region, value FROM events)"


@query(f"WITH {_BOLD} SELECT t, region, round(avg(value), 9) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS n FROM bold GROUP BY t, region")
def mean_timeseries(spark, sf_dir):
    x = tabular.time_axis(table(spark, sf_dir, "events"), 1.0, "event_id", "user_id", "event_type").withColumn("t", F.col("t").cast("long"))
    got = tabular.mean_std(x.withColumnRenamed("event_type", "region"), ["t", "region"])
    return got.select("t", "region", F.round("mean", 9).alias("mean"), F.round("std", 6).alias("std"), "n")


_THICK = "thick AS (SELECT l_orderkey AS vertex, l_linenumber AS layer, sum(CASE WHEN l_orderkey % 11 = 0 THEN 0 ELSE l_quantity END) AS thickness FROM lineitem GROUP BY ALL)"


@query(f"WITH {_THICK}, c AS (SELECT *, sum(thickness) OVER (PARTITION BY vertex ORDER BY layer) AS s, sum(thickness) OVER (PARTITION BY vertex) AS a, max(layer) OVER (PARTITION BY vertex) AS l FROM thick) SELECT vertex, layer, round(CASE WHEN layer = l THEN 1.0::DOUBLE ELSE s / a END, 9) AS depth FROM c WHERE a > 0")
def layer_depths(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("vertex"), F.col("l_linenumber").alias("layer")).agg(F.sum(F.when(F.col("l_orderkey") % 11 == 0, 0.0).otherwise(F.col("l_quantity"))).alias("thickness"))
    return tabular.layer_depths(rows, "thickness", "layer", "vertex").select("vertex", "layer", F.round("depth", 9).alias("depth"))


@query(f"WITH {TOPS}, r AS (SELECT l_tax * 10 AS depth, l_quantity AS value FROM lineitem), a AS (SELECT r.value, (SELECT max(layer) FROM tops WHERE top < depth) AS layer FROM r) SELECT layer, round(avg(value), 9) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS n FROM a WHERE layer BETWEEN 1 AND 6 GROUP BY layer")
def layer_statistics(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_tax") * 10).alias("depth"), F.col("l_quantity").alias("value"))
    got = tabular.layer_statistics(rows, _tops(spark))
    return got.select("layer", F.round("mean", 9).alias("mean"), F.round("std", 6).alias("std"), "n")


@query("WITH layers(layer, area) AS (VALUES (1, 1200.0), (2, 3400.5), (3, 800.0), (4, 950.25)), c AS (SELECT l_returnflag AS section, l_linenumber AS layer, count(*) AS counts FROM lineitem GROUP BY ALL) SELECT section, layer, counts, round(area * 20 * cbrt(1.931) / 1000000, 9) AS volume, round(counts / (area * 20 * cbrt(1.931) / 1000000), 5) AS density FROM c JOIN layers USING (layer)")
def layer_densities(spark, sf_dir):
    areas = spark.createDataFrame([(1, 1200.0), (2, 3400.5), (3, 800.0), (4, 950.25)], "layer int, area double")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("section"), F.col("l_linenumber").alias("layer"))
    sections = lines.select("section").distinct()
    got = tabular.layer_densities(lines, areas.withColumn("section", F.explode(F.lit(["A", "N", "R"]))).join(sections, "section"), "section")
    return got.select("section", "layer", "counts", F.round("volume", 9).alias("volume"), F.round("density", 5).alias("density"))


@query("SELECT CAST(floor(value / 100) AS BIGINT) AS gx, CAST(floor((event_id % 1000) / 100) AS BIGINT) AS gy, count(*) AS n FROM events GROUP BY 1, 2")
def grid_counts(spark, sf_dir):
    return tabular.grid_counts(table(spark, sf_dir, "events").select(F.col("value").alias("x"), (F.col("event_id") % 1000).alias("y")))


@query("SELECT l_linestatus, CAST(least(floor((l_quantity - 0.5) / 50 * 10), 9) AS BIGINT) AS bin, round(avg(l_tax), 9) AS mean, count(*) AS n FROM lineitem GROUP BY 1, 2")
def depth_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", ((F.col("l_quantity") - 0.5) / 50).alias("depth"), F.col("l_tax").alias("value"))
    got = tabular.depth_profile(rows, 10, "depth", "value", "l_linestatus")
    return got.select("l_linestatus", "bin", F.round("mean", 9).alias("mean"), "n")


@query("WITH m AS (SELECT user_id, event_type, median(10 * log10(value)) AS m FROM events GROUP BY ALL) SELECT event_type AS freq, round(avg(m), 9) AS power, count(m) AS files FROM m GROUP BY event_type")
def spectrum(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_type").alias("freq"), "value")
    return tabular.spectrum(rows, tabular.decibel(F.col("value"))).select("freq", F.round("power", 9).alias("power"), "files")


_KEYS = "e AS (SELECT event_type, nullif(user_id % 5, 0) AS quality FROM events)"


@query(f"WITH {_KEYS} SELECT event_type, quality, count(*) AS recordings FROM e WHERE event_type IS NOT NULL AND quality IS NOT NULL GROUP BY ALL")
def grouped_recordings(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.nullif(F.col("user_id") % 5, F.lit(0)).alias("quality"))
    return tabular.grouped_recordings(rows, ["event_type", "quality"])


@query("SELECT array_to_string(list_sort(list(DISTINCT event_type)), ',') AS event_type, array_to_string(list_sort(list(DISTINCT user_id % 5)), ',') AS quality FROM events")
def recording_options(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 5).alias("quality"))
    got = tabular.options(rows, "event_type", "quality")
    return got.select(F.array_join("event_type", ",").alias("event_type"), F.array_join("quality", ",").alias("quality"))


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND user_id = 12")
def filtered_recordings(spark, sf_dir):
    return tabular.filter_recordings(table(spark, sf_dir, "events"), event_type=["view", "click"], user_id=12, props=None).select("event_id")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size + 0.5 ELSE 0 END::DOUBLE AS value FROM part")
def fingerprint_values(spark, sf_dir):
    raw = F.when(F.col("p_size") % 2 == 0, F.concat("p_size", F.lit(".5"))).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", tabular.fingerprint_value(raw).alias("value"))


@query("SELECT p_partkey, coalesce(t, '(undeciphered)') AS neurotransmitter FROM part LEFT JOIN (VALUES ('PROMO', 'glutamate'), ('SMALL', 'GABA')) v(s, t) ON s = p_type")
def neurotransmitters(spark, sf_dir):
    v = spark.createDataFrame([("PROMO", "glutamate"), ("SMALL", "GABA")], "symbol string, transmitter string")
    return tabular.neurotransmitters(table(spark, sf_dir, "part"), v, "p_type").select("p_partkey", "neurotransmitter")


@query("""
WITH s(sample, x, y, z) AS (VALUES (0, 1.0, 2.0, 3.0), (1, -4.0, 5.5, 0.25)), d(donor_id, k, off, race, age_days) AS (VALUES (0, 1.0, 0.125, 'a', 9000), (1, 2.0, -3.0, 'b', 20000)),
p AS (SELECT p_partkey, p_name, p_partkey % 2 AS donor_id, unnest([0, 1]) AS sample, p_size FROM part)
SELECT p_partkey AS probe_id, p_name AS gene, CAST(p.sample AS INTEGER) AS sample, p_size + p.sample * 0.5::DOUBLE AS level, race, CAST(trunc(age_days / 365.0) AS INTEGER) AS age, CAST(x * k + off AS DOUBLE) AS px, CAST(y * k AS DOUBLE) AS py FROM p JOIN s ON s.sample = p.sample JOIN d ON d.donor_id = p.donor_id
""".replace("x * k + off AS DOUBLE", "round_even(x * k + off, 2) AS DOUBLE"))
def gene_expressions(spark, sf_dir):
    probes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("probe_id"), F.col("p_name").alias("gene"), (F.col("p_partkey") % 2).cast("int").alias("donor_id"), F.array(F.col("p_size") + 0.0, F.col("p_size") + 0.5).alias("level"), F.array(F.lit(0.0), F.lit(1.0)).alias("zscore"))
    samples = spark.createDataFrame([(d, *r) for d in (0, 1) for r in ((0, 1.0, 2.0, 3.0), (1, -4.0, 5.5, 0.25))], "donor_id int, sample int, x double, y double, z double")
    donors = spark.createDataFrame([(d, [k, 0.0, 0.0, off, 0.0, k, 0.0, 0.0, 0.0, 0.0, k, 0.0], race, sex, days) for d, k, off, race, sex, days in ((0, 1.0, 0.125, "a", "f", 9000), (1, 2.0, -3.0, "b", "m", 20000))], "donor_id int, affine array<double>, race string, gender string, age_days int")
    x = tabular.expressions(probes, samples, donors)
    return x.select("probe_id", "gene", "sample", "level", "race", "age", F.get("place", F.lit(0)).alias("px"), F.get("place", F.lit(1)).alias("py"))


@query("WITH d AS (SELECT p_size AS x, p_partkey % 20 AS y, avg(p_retailprice) AS depth FROM part GROUP BY ALL), b AS (SELECT DISTINCT p_size AS x, p_partkey % 20 AS y, p_size % 4 AS boundary FROM part WHERE p_size < 30) SELECT boundary, round(avg(depth), 9) AS depth FROM b JOIN d USING (x, y) GROUP BY boundary")
def boundary_depth(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("x"), (F.col("p_partkey") % 20).alias("y"), "p_retailprice")
    depths = p.groupBy("x", "y").agg(F.avg("p_retailprice").alias("depth"))
    edge = p.filter("x < 30").select("x", "y", (F.col("x") % 4).alias("boundary")).distinct()
    return tabular.mean_depth(edge, depths).select("boundary", F.round("depth", 9).alias("depth"))
