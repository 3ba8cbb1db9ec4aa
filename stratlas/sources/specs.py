"""Catalogues of JSON specifications, tagged by type, as one table per concept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratlas.session import materialise

#: Type tag -> function from the table of specs of that tag to the concept's table.
BUILDERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def build_type(tag: str):
    """Register how specs of a type become rows."""

    def add(f: Callable[[DataFrame], DataFrame]):
        BUILDERS[tag] = f
        return f

    return add


def read_specs(spark: SparkSession, *folders: str) -> DataFrame:
    """All specs below the folders as (filename, type, spec); a later folder's file replaces one of the same name."""
    out = None
    for rank, folder in enumerate(folders):
        files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder)
        rows = files.select(F.col("_metadata.file_name").alias("filename"), F.get_json_object("value", "$['@type']").alias("type"), F.col("value").alias("spec"), F.lit(rank).alias("rank"))
        out = rows if out is None else out.union(rows)
    if len(folders) < 2:
        return out.drop("rank")
    return out.groupBy("filename").agg(F.max_by(F.struct("type", "spec"), "rank").alias("s")).select("filename", "s.type", "s.spec")


def build(specs: DataFrame, tag: str) -> DataFrame:
    return BUILDERS[tag](specs.filter(F.col("type") == tag))


def field(path: str):
    return F.get_json_object("spec", path)


@build_type("parcellation")
def parcellations(specs: DataFrame) -> DataFrame:
    return specs.select(field("$['@id']").alias("id"), field("$.name").alias("name"), field("$['@version'].name").alias("version"), field("$['@version']['@prev']").alias("previous"), F.coalesce(field("$['@version'].deprecated").cast("boolean"), F.lit(False)).alias("deprecated"))


@build_type("space")
def spaces(specs: DataFrame) -> DataFrame:
    return specs.select(field("$['@id']").alias("id"), field("$.name").alias("name"), field("$.shortName").alias("short_name"), F.size(F.from_json(field("$.volumes"), "array<string>")).alias("n_volumes"))


@build_type("map")
def map_index(specs: DataFrame) -> DataFrame:
    """(map_id, region, volume, label, fragment) of all maps' indices."""
    entry = "map<string,array<struct<volume:int,label:int,fragment:string>>>"
    regions = specs.select(field("$['@id']").alias("map_id"), F.explode(F.from_json(field("$.indices"), entry)).alias("region", "at"))
    return regions.select("map_id", "region", F.explode("at").alias("i")).select("map_id", "region", F.coalesce("i.volume", F.lit(0)).alias("volume"), "i.label", "i.fragment")


#: Regions nested deeper than this are an error.
MAX_DEPTH = 64


def regions(specs: DataFrame) -> DataFrame:
    """(parcellation_id, name, parent, ord) of the nested region lists of parcellation specs, level by level down to the last."""
    level = specs.filter("type = 'parcellation'").select(field("$['@id']").alias("parcellation_id"), F.lit(None).cast("string").alias("parent"), field("$.regions").alias("list"))
    out = None
    for _ in range(MAX_DEPTH + 1):
        rows = level.select("parcellation_id", "parent", F.posexplode(F.from_json("list", "array<string>")).alias("ord", "r"))
        rows = materialise(rows.select("parcellation_id", "parent", "ord", F.get_json_object("r", "$.name").alias("name"), F.get_json_object("r", "$.rgb").alias("rgb"), F.get_json_object("r", "$.children").alias("list")))
        out = rows.drop("list") if out is None else out.union(rows.drop("list"))
        level = rows.filter("list is not null").select("parcellation_id", F.col("name").alias("parent"), "list")
        if level.isEmpty():
            return out
    raise ValueError(f"regions are nested deeper than {MAX_DEPTH}")
