"""Choosing from metadata: scales, templates, maps of a region, newest versions, listed datasets.

These read the small metadata tables only; voxels are touched by what they choose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratlas.functions.names import contains_all

AXES = ("x", "y", "z")


def resolves(resolution: float, ignore: str | None = None) -> Column:
    """A scale (res_x, res_y, res_z in mm) is at least as fine as asked for, along all axes but the ignored one."""
    if resolution < 0:
        return F.lit(True)
    ok = F.lit(True)
    for a in AXES:
        if a != ignore:
            ok = ok & (F.col(f"res_{a}") <= resolution)
    return ok


def select_scales(scales: DataFrame, resolution: float | None = None, max_bytes: float = 0.2 * 1024**3, ignore: str | None = None) -> DataFrame:
    """One scale per volume: the coarsest that still resolves (the finest without a wish), or the next coarser ones until it fits.

    Scales are rows (volume_id, scale, res_*, n_x, n_y, n_z, item_bytes), scale 0
    the finest; a volume of which no scale will do has a null scale.
    """
    size = F.col("n_x").cast("double") * F.col("n_y") * F.col("n_z") * F.col("item_bytes")
    wish = F.min("scale") if resolution is None or resolution < 0 else F.max(F.when(resolves(resolution, ignore), F.col("scale")))
    wished = scales.groupBy("volume_id").agg(wish.alias("wished"))
    fits = scales.join(wished, "volume_id").groupBy("volume_id", "wished").agg(F.min(F.when((F.col("scale") >= F.col("wished")) & (size <= max_bytes), F.col("scale"))).alias("scale"))
    return fits.withColumn("changed", F.col("scale") > F.col("wished"))


def template(volumes: DataFrame, variant: str | None = None) -> DataFrame:
    """The first template volume of each space whose variant holds the given word."""
    if variant:
        volumes = volumes.filter(F.contains(F.lower("variant"), F.lit(variant.lower())))
    return volumes.withColumn("_n", F.row_number().over(Window.partitionBy("space_id").orderBy("ord"))).filter("_n = 1").drop("_n")


def format_of(available: Column, *preferred: str) -> Column:
    """The first preferred format that a volume has."""
    return F.get(F.filter(F.array(*[F.lit(p) for p in preferred]), lambda p: F.array_contains(available, p)), F.lit(0))


def newest(parcellations: DataFrame) -> DataFrame:
    return parcellations.filter("next is null")


def regional_maps(index: DataFrame, maps: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, map_id): the first map in registry order that holds each region."""
    held = index.select("map_id", "region").distinct().join(regions.select("region").distinct(), "region").join(maps.select("map_id", "ord"), "map_id")
    return held.groupBy("region").agg(F.min_by("map_id", "ord").alias("map_id"))


def colormap(index: DataFrame, regions: DataFrame) -> DataFrame:
    """(map_id, label, r, g, b): labels with their region's colour; regions without one are left out."""
    return index.join(regions.select("region", "rgb"), "region").filter("rgb is not null and label is not null").select("map_id", "label", "rgb.*").distinct()


def listed_datasets(regions: DataFrame, species: DataFrame, blocked: tuple[str, ...] = ()) -> DataFrame:
    """(region, dataset_id, name, version) of datasets attached to regions.

    Regions hold arrays of datasets (id, name, species); ids must say dataset,
    the species must be known, and names must hold none of the blocked words.  A
    version is what stands in brackets at the end of a name.
    """
    d = regions.select(F.coalesce("alias", "name").alias("region"), F.explode("datasets").alias("d")).select("region", "d.*")
    d = d.filter(F.contains("id", F.lit("dataset"))).join(species.select("species"), "species", "left_semi")
    for word in blocked:
        d = d.filter(~F.contains(F.lower("name"), F.lit(word.lower())))
    version = r"^(.*?) *\((v[0-9][0-9.]*)\) *$"
    has = F.col("name").rlike(version)
    return d.select("region", F.col("id").alias("dataset_id"), F.when(has, F.regexp_extract("name", version, 1)).otherwise(F.col("name")).alias("name"), F.when(has, F.regexp_extract("name", version, 2)).alias("version"))


def words_in(spec: str, column: str) -> Column:
    return contains_all(F.col(column), F.lit(spec), " ")
