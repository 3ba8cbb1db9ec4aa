"""Data features and their anchors: which features relate to a concept, how, and in which order.

A feature's anchor is either a region (by id, after names and aliases are
resolved) or a box.  All features are matched in one join over the closure of the
region tree, or over boxes, never feature by feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratlas.functions import ids
from stratlas.functions.names import contains_all
from stratlas.operators import locations
from stratlas.operators.assignment import CODES

# Fixed values: (type, category, compound key, element index).
FEATURE_TYPES = (
    ("StreamlineCounts", "connectivity", ("modality", "cohort"), "subject"),
    ("StreamlineLengths", "connectivity", ("modality", "cohort"), "subject"),
    ("TracingConnectivity", "connectivity", ("modality", "cohort"), "subject"),
    ("FunctionalConnectivity", "connectivity", ("modality", "cohort", "paradigm"), "subject"),
    ("AnatomoFunctionalConnectivity", "connectivity", ("modality", "cohort"), "feature"),
    ("RegionalBOLD", "functional", ("modality", "cohort", "paradigm"), "subject"),
    ("LocalFieldPotential", "functional", (), None),
    ("RegionalLocalFieldPotential", "functional", (), None),
    ("ReceptorDensityFingerprint", "molecular", (), None),
    ("ReceptorDensityProfile", "molecular", ("modality",), "receptor"),
    ("GeneExpressions", "molecular", (), None),
    ("CellDensityProfile", "cellular", ("modality",), "location"),
    ("LayerwiseCellDensity", "cellular", (), None),
    ("IntensityProfile", "cellular", ("modality",), "location"),
    ("LayerwiseIntensities", "cellular", (), None),
    ("CellbodyStainedSection", "cellular", (), None),
    ("CellbodyStainedPatch", "cellular", (), None),
    ("CellBodyStainedVolumeOfInterest", "cellular", (), None),
    ("XPCTVolumeOfInterest", "cellular", (), None),
    ("LSFMVolumeOfInterest", "cellular", (), None),
    ("BlockfaceVolumeOfInterest", "macrostructural", (), None),
    ("MRIVolumeOfInterest", "macrostructural", (), None),
    ("MorphometryVolumeOfInterest", "macrostructural", (), None),
    ("DTIVolumeOfInterest", "fibres", (), None),
    ("PLIVolumeOfInterest", "fibres", (), None),
    ("Tabular", "generic", (), None),
    ("Image", "generic", (), None),
    ("DatasetFeature", "other", (), None),
)


def feature_types(spark) -> DataFrame:
    return spark.createDataFrame([(t, c, list(k), i) for t, c, k, i in FEATURE_TYPES], "type string, category string, compound_key array<string>, element string")


def parse_type(types: DataFrame, spec: str) -> DataFrame:
    """The types all of whose name holds every word of the spec, or of its category."""
    return types.filter(contains_all(F.col("type"), F.lit(spec), " ") | (F.lower("category") == spec.lower())).orderBy("type")


def resolve_aliases(anchors: DataFrame, aliases: DataFrame, names: DataFrame) -> DataFrame:
    """(feature_id, region_id, code): anchors' region specs by name (EXACT), or else by alias with the alias's own code."""
    named = anchors.join(names.select(F.col("name").alias("region_spec"), "region_id"), "region_spec").select("feature_id", "region_id", F.lit(CODES["EXACT"]).alias("code"))
    other = anchors.join(aliases.select("region_spec", "species", "alias", F.col("code")), ["region_spec", "species"]).join(names.select(F.col("name").alias("alias"), "region_id"), "alias").select("feature_id", "region_id", "code")
    return named.union(other).groupBy("feature_id", "region_id").agg(F.min("code").alias("code"))


def match_regions(anchors: DataFrame, closure: DataFrame, concepts: DataFrame) -> DataFrame:
    """(feature_id, concept, code): anchor regions that are a concept, lie in it, or hold it."""
    at = anchors.select("feature_id", F.col("region_id").alias("r"), F.col("code").alias("anchor_code"))
    c = concepts.select(F.col("region_id").alias("concept"))
    down = closure.join(c, F.col("ancestor") == F.col("concept")).select("concept", F.col("descendant").alias("r"), F.when(F.col("distance") == 0, CODES["EXACT"]).otherwise(CODES["CONTAINED"]).alias("code"))
    up = closure.filter("distance > 0").join(c, F.col("descendant") == F.col("concept")).select("concept", F.col("ancestor").alias("r"), F.lit(CODES["CONTAINS"]).alias("code"))
    return at.join(down.union(up), "r").select("feature_id", "concept", F.greatest("code", "anchor_code").alias("code"))


def match_boxes(anchors: DataFrame, concepts: DataFrame) -> DataFrame:
    """(feature_id, concept, code): anchor boxes that meet a concept's box."""
    pairs = locations.intersect_boxes(anchors, concepts, "feature_id", "concept").select("feature_id", "concept")
    b = concepts.select("concept", *[F.col(c).alias(c + "_b") for c in (*locations.LOW, *locations.HIGH)])
    full = pairs.join(anchors, "feature_id").join(b, "concept").withColumn("how", locations.relation())
    return full.select("feature_id", "concept", F.create_map(*[x for k, v in CODES.items() for x in (F.lit(k), F.lit(v))])[F.col("how")].alias("code"))


def get(features: DataFrame, matches: DataFrame, types: DataFrame) -> DataFrame:
    """Features of the types that match, each with its best code, best first; ties in catalogue order."""
    best = matches.groupBy("feature_id").agg(F.min("code").alias("code"))
    return features.join(F.broadcast(types.select("type")), "type", "left_semi").join(best, "feature_id").orderBy("code", "ord")


def with_live(catalogue: DataFrame, live: DataFrame) -> DataFrame:
    """Catalogue and live results, each id once, the catalogue's row first."""
    both = catalogue.withColumn("_live", F.lit(0)).unionByName(live.withColumn("_live", F.lit(1)))
    cols = [c for c in catalogue.columns if c != "feature_id"]
    return both.groupBy("feature_id").agg(F.min(F.struct("_live", *cols)).alias("r")).select("feature_id", *[F.col("r." + c).alias(c) for c in cols])


def compounds(features: DataFrame, types: DataFrame, keys: tuple[str, ...] = ("modality", "cohort", "paradigm")) -> DataFrame:
    """Features grouped by type and by the attributes their type is compounded by: elements and their indices.

    Groups of one, and types without such a key, stay single.
    """
    x = features.join(F.broadcast(types.select("type", "compound_key")), "type")
    used = [F.when(F.array_contains("compound_key", k), F.col(k)).alias("k_" + k) for k in keys]
    alone = F.when(F.size("compound_key") == 0, F.col("feature_id")).alias("alone")
    groups = x.groupBy("type", *used, alone).agg(F.count("*").alias("elements"), F.sort_array(F.collect_list("feature_id")).alias("feature_ids"), F.min("ord").alias("ord"))
    return groups.withColumn("compound", F.col("elements") > 1).drop("alone")


def merge_anchors(anchors: DataFrame, groups: DataFrame) -> DataFrame:
    """One anchor per group: all regions, the box of all boxes; null where the species differ."""
    x = anchors.join(groups, "feature_id").groupBy("group").agg(
        F.count_distinct("species").alias("n"), F.min("species").alias("species"), F.sort_array(F.collect_set("region_id")).alias("regions"), *[F.min(c).alias(c) for c in locations.LOW], *[F.max(c).alias(c) for c in locations.HIGH]
    )
    return x.withColumn("species", F.when(F.col("n") == 1, F.col("species"))).drop("n")


def roll_up(features: DataFrame, by: str, column: str, separator: str = "; ") -> DataFrame:
    """Different texts of a group as one: licences, descriptions, authors."""
    return features.filter(F.col(column).isNotNull()).groupBy(by).agg(F.array_join(F.sort_array(F.collect_set(column)), separator).alias(column))


def latest_contributors(versions: DataFrame) -> DataFrame:
    """Contributors over all versions of a dataset, each id once with what its last version says."""
    return versions.select("dataset", "ord", F.explode("contributors").alias("c")).groupBy("dataset", F.col("c.id").alias("id")).agg(F.max_by("c.name", "ord").alias("name"))


def reference_url(x: Column) -> Column:
    return F.when(x.startswith("http"), x).otherwise(F.concat(F.lit("https://doi.org/"), x))


def display_name(full: Column, parents: Column, version: Column) -> Column:
    """The full name, else the first parent name that isn't empty, with the version."""
    return F.concat(F.coalesce(F.when(full != "", full), F.get(F.filter(parents, lambda p: p != ""), F.lit(0))), F.lit(" ("), version, F.lit(")"))


def type_tree(types: DataFrame) -> DataFrame:
    """(id, parent, name) of the feature types below their categories, to be walked and rendered like a region tree."""
    top = types.select(F.col("category").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("category").alias("name")).distinct()
    return top.union(types.select(F.concat_ws("/", "category", "type"), "category", "type"))


def by_id(features: DataFrame, compounds: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, feature_id, error): the features that ids mean, all at once.

    An id is that of a compound (``cf0::``, looked up by ``compound_id``), of a
    live query's result (``lq0::``, looked up by the id behind its concept), or a
    feature's own.  Ids that mean nothing keep a null feature and say why.
    """
    live = F.when(F.col("wanted").startswith("lq"), ids.decode_query_context(F.col("wanted")))
    x = wanted.select("wanted").distinct().withColumn("live", live).withColumn("key", F.coalesce(F.col("live")["id"], F.col("wanted")))
    both = features.select(F.col("feature_id").alias("key"), "feature_id", F.lit(False).alias("compound")).union(compounds.select(F.col("compound_id"), "feature_id", F.lit(True)))
    found = x.join(both.withColumn("of", F.col("compound")), "key", "left").filter("of is null or of = startswith(wanted, 'cf0::')")
    error = F.coalesce(F.col("live")["error"], F.when(F.col("feature_id").isNull(), "unknown"))
    return found.select("wanted", F.when(error.isNull(), F.col("feature_id")).alias("feature_id"), error.alias("error"))


LIVE: dict = {}


def live_query(feature_type: str):
    """Register ``f(spark, concepts, **arguments) -> DataFrame`` as a source of features of a type."""

    def add(f):
        LIVE.setdefault(feature_type, []).append(f)
        return f

    return add


def run_live(spark, feature_type: str, concepts: DataFrame, **arguments) -> DataFrame | None:
    out = None
    for f in LIVE.get(feature_type, ()):
        got = f(spark, concepts, **arguments)
        out = got if out is None else out.unionByName(got)
    return out
