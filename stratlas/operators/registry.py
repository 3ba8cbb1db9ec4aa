"""Registries: named things in order, found by key, position, match or words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratlas.functions.names import concept_matches, contains_all


def find(items: DataFrame, spec: str, key: str = "key", id: str = "id", name: str = "name", order: str = "ord") -> DataFrame:
    """The rows of the best tier that has any: key equal, position, match, all words in the key."""
    s = F.lit(spec)
    tier = F.when(F.col(key) == s, 0)
    if spec.lstrip("-").isdigit():
        tier = tier.when(F.col(order) == int(spec), 1)
    tier = tier.when(concept_matches(s, F.col(key), F.col(id), F.col(name)), 2).when(contains_all(F.col(key), s), 3)
    tiers = items.withColumn("_tier", tier).filter("_tier is not null")
    best = tiers.agg(F.min("_tier").alias("_best"))
    return tiers.join(F.broadcast(best), F.col("_tier") == F.col("_best")).drop("_tier", "_best")


def get(items: DataFrame, spec: str, by: Column, **columns: str) -> DataFrame:
    """The found row that is largest by ``by``: of several versions the newest."""
    return find(items, spec, **columns).orderBy(by.desc()).limit(1)


def provides(items: DataFrame, spec: str, **columns: str) -> bool:
    return not find(items, spec, **columns).isEmpty()


def closest(items: DataFrame, spec: str, key: str = "key", n: int = 3) -> DataFrame:
    """The keys with the smallest edit distance to a spec, for a did-you-mean."""
    return items.select(key, F.levenshtein(F.col(key), F.lit(spec)).alias("distance")).orderBy("distance", key).limit(n)


def without(items: DataFrame, id, column: str = "id") -> DataFrame:
    return items.filter(~F.col(column).eqNullSafe(F.lit(id)))


def first_per(items: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each group."""
    return items.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def select_map(maps: DataFrame, space: str | None = None, parcellation: str | None = None, maptype: str | None = None, spec: str | None = None) -> DataFrame:
    """The first map in registry order that fits everything given; words of ``spec`` are looked up in the id."""
    for column, value in (("space_id", space), ("parcellation_id", parcellation), ("maptype", maptype)):
        if value is not None:
            maps = maps.filter(F.col(column) == value)
    if spec is not None:
        maps = maps.filter(contains_all(F.col("id"), F.lit(spec), " "))
    return maps.orderBy("ord").limit(1)


def map_types(index: DataFrame) -> DataFrame:
    """Per map: its labels and whether it is labelled (no null label) or statistical (only null labels)."""
    return index.groupBy("map_id").agg(F.sort_array(F.collect_set("label")).alias("labels"), F.when(F.bool_and(F.col("label").isNull()), "STATISTICAL").when(F.bool_and(F.col("label").isNotNull()), "LABELLED").alias("maptype"))


def duplicate_indices(index: DataFrame) -> DataFrame:
    """Indices that more than one region of a map has."""
    return index.groupBy("map_id", "volume", "label", "fragment").agg(F.count("*").alias("regions")).filter("regions > 1")


def region_of(index: DataFrame, map_id: str, volume: int = 0, label: int | None = None, fragment: str | None = None) -> DataFrame:
    """The regions that an index of a map means; nulls equal nulls."""
    at = F.col("label").eqNullSafe(F.lit(label)) & F.col("fragment").eqNullSafe(F.lit(fragment))
    return index.filter((F.col("map_id") == map_id) & (F.col("volume") == volume) & at).select("region")


def indices_of(index: DataFrame, regions: DataFrame) -> DataFrame:
    """The indices of each region: its own, or else those of the regions below it (region, ancestor)."""
    below = regions.select("ancestor", "region")
    own = index.join(regions.select(F.col("ancestor").alias("region")).distinct(), "region").select(F.col("region").alias("ancestor"), "map_id", "volume", "label", "fragment")
    rest = below.join(own.select("ancestor").distinct(), "ancestor", "left_anti").join(index, "region").select("ancestor", "map_id", "volume", "label", "fragment")
    return own.union(rest)


def unique_index(found: DataFrame) -> DataFrame:
    """Found indices (ancestor, ...) with an error where a region has not exactly one."""
    one = found.groupBy("ancestor").agg(F.count("*").alias("n"), F.first("map_id").alias("map_id"), F.first("volume").alias("volume"), F.first("label").alias("label"), F.first("fragment").alias("fragment"))
    bad = F.raise_error(F.concat(F.col("ancestor"), F.lit(" has "), F.col("n").cast("string"), F.lit(" indices")))
    return one.select("ancestor", F.when(F.col("n") == 1, F.col("map_id")).otherwise(bad).alias("map_id"), "volume", "label", "fragment")
