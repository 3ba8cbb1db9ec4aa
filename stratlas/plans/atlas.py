"""One object over the tables of a catalogue, with the questions users ask by name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratlas.functions import geometry as G
from stratlas.functions.names import region_matches
from stratlas.operators import assignment, features, hierarchy, registry, selection, voxels


@dataclass
class Atlas:
    """Tables: regions (id, parent, name, key, parcellation_id), maps, map index, voxels, and templates."""

    regions: DataFrame
    maps: DataFrame
    index: DataFrame
    voxels: DataFrame
    templates: DataFrame | None = None
    parcellations: DataFrame | None = None

    def tree(self, parcellation: str | None = None) -> DataFrame:
        r = self.regions if parcellation is None else self.regions.filter(F.col("parcellation_id") == parcellation)
        return hierarchy.with_paths(r)

    def find_regions(self, spec: str, parcellation: str | None = None, all_versions: bool = True, **how) -> DataFrame:
        """Regions that match a spec, in one parcellation or in all, or only in the newest ones."""
        tree = self.tree(parcellation)
        if not all_versions and self.parcellations is not None:
            tree = tree.join(selection.newest(self.parcellations).select(F.col("id").alias("parcellation_id")), "parcellation_id", "left_semi")
        return hierarchy.find(tree, region_matches(F.lit(spec), F.col("key"), F.col("id"), F.col("name")), **how)

    def get_regions(self, specs: DataFrame, parcellation: str) -> DataFrame:
        """Each spec's one region, or how many it could mean."""
        match = region_matches(F.col("spec"), F.col("key"), F.col("id"), F.col("name"))
        return hierarchy.resolve(self.tree(parcellation), specs, match)

    def get_map(self, space: str | None = None, parcellation: str | None = None, maptype: str | None = None, spec: str | None = None) -> DataFrame:
        return registry.select_map(self.maps, space, parcellation, maptype, spec)

    def get_template(self, space: str, variant: str | None = None) -> DataFrame:
        return selection.template(self.templates.filter(F.col("space_id") == space), variant)

    def region_voxels(self, region: str, threshold: float = 0.0) -> DataFrame:
        """The mask of a region and all that is below it."""
        tree = hierarchy.with_paths(self.regions)
        below = tree.filter(F.array_contains("path", F.lit(region))).select(F.col("name").alias("region"))
        return voxels.region_mask(self.voxels, self.index, below, threshold)

    def assign(self, points: DataFrame, to_voxel: G.Matrix, sigma_voxels: float | str | None = None, threshold: float = 0.0) -> DataFrame:
        """Points, certain, with one uncertainty or with a column of them, to regions."""
        if sigma_voxels:
            return assignment.assign_uncertain(points, self.voxels, self.index, to_voxel, sigma_voxels, threshold=threshold)
        return assignment.assign_points(points, self.voxels, self.index, to_voxel, threshold=threshold)

    def features(self, catalogue: DataFrame, anchors: DataFrame, concepts: DataFrame, types: str) -> DataFrame:
        """Features of a type that relate to concepts, best first."""
        closure = hierarchy.closure(hierarchy.with_paths(self.regions))
        kinds = features.parse_type(features.feature_types(catalogue.sparkSession), types)
        return features.get(catalogue, features.match_regions(anchors, closure, concepts), kinds)
