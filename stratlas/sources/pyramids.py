"""Volumes stored at halved scales: write all scales of a volume, read a box of it at the scale that a wish asks for.

A folder has the voxels under ``voxels/scale=k``, partitioned by blocks, and one row
per scale (scale, resolution_mm, sx, sy, sz) under ``scales``.  Voxel x of a scale
covers x to x + 1 times its resolution.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratlas.operators import voxels as V

XYZ = ("x", "y", "z")
#: Bytes of a voxel in an estimate.
VOXEL_BYTES = 8
MAX_BYTES = 200 << 20
Box = tuple[tuple[float, float, float], tuple[float, float, float]]


@dataclass(frozen=True)
class Scale:
    scale: int
    resolution_mm: float
    sx: int
    sy: int
    sz: int

    def voxels_of(self, box: Box | None) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """The voxels that a box in mm touches, within the volume; the upper ends lie one beyond."""
        size = (self.sx, self.sy, self.sz)
        if box is None:
            return (0, 0, 0), size
        # A bound that rounding has put a hair beyond a voxel's face is on the face.
        low = tuple(min(max(0, math.floor(a / self.resolution_mm + 1e-9)), n) for a, n in zip(box[0], size, strict=True))
        high = tuple(min(max(0, math.ceil(b / self.resolution_mm - 1e-9)), n) for b, n in zip(box[1], size, strict=True))
        return low, high

    def bytes_of(self, box: Box | None) -> int:
        return VOXEL_BYTES * math.prod(max(0, b - a) for a, b in zip(*self.voxels_of(box), strict=True))


def halve(voxels: DataFrame, labels: bool) -> DataFrame:
    """A volume at half its resolution: labels by the voxel at the lower corner of each eight, values by the eight's mean (what isn't there counts 0)."""
    half = [F.floor(F.col(c) / 2).cast("int").alias(c) for c in XYZ]
    if labels:
        return voxels.filter("pmod(x, 2) = 0 and pmod(y, 2) = 0 and pmod(z, 2) = 0").select(*half, "value")
    return voxels.groupBy(*half).agg((F.sum("value") / 8).alias("value")).filter("value <> 0")


def write_pyramid(voxels: DataFrame, folder: str, resolution_mm: float, size: tuple[int, int, int], levels: int, labels: bool = False, block: int = V.BLOCK) -> list[Scale]:
    """Write a volume (x, y, z, value; background left out) and ``levels - 1`` halvings, each made from the one before; a block is one file at most.

    Voxels without a place or value are left out, and so are those outside of 0 to size - 1.
    """
    spark = voxels.sparkSession
    inside = [(F.col(c) >= 0) & (F.col(c) < n) for c, n in zip(XYZ, size, strict=True)]
    level = voxels.select(*[F.col(c).cast("int").alias(c) for c in XYZ], F.col("value").cast("double").alias("value")).filter(inside[0] & inside[1] & inside[2] & (F.col("value") != 0))
    scales = []
    for k in range(levels):
        path = f"{folder}/voxels/scale={k}"
        scales.append(Scale(k, resolution_mm * 2**k, *(max(1, math.ceil(n / 2**k)) for n in size)))
        V.with_blocks(level, block).repartition("bx", "by", "bz").write.partitionBy("bx", "by", "bz").parquet(path)
        kinds = "x int, y int, z int, value double, bx int, by int, bz int"
        level = halve(spark.read.schema(kinds).parquet(path).select(*XYZ, "value"), labels)
    spark.createDataFrame([(s.scale, s.resolution_mm, s.sx, s.sy, s.sz, block) for s in scales], "scale int, resolution_mm double, sx int, sy int, sz int, block int").coalesce(1).write.parquet(f"{folder}/scales")
    return scales


def choose(scales: list[Scale], resolution_mm: float | None = None, box: Box | None = None, max_bytes: int = MAX_BYTES) -> Scale:
    """The coarsest scale that resolves the wish (the finest without one, or with a negative one), made coarser until the box fits into ``max_bytes``.

    A wish finer than all scales, or a box that no scale brings under the cap, is an error.
    """
    ordered = sorted(scales, key=lambda s: s.resolution_mm)
    first = 0
    if resolution_mm is not None and resolution_mm >= 0:
        fine = [i for i, s in enumerate(ordered) if s.resolution_mm <= resolution_mm]
        if not fine:
            raise ValueError(f"no scale resolves {resolution_mm} mm; there are {[s.resolution_mm for s in ordered]}")
        first = fine[-1]
    fits = [s for s in ordered[first:] if s.bytes_of(box) <= max_bytes]
    if not fits:
        raise ValueError(f"no scale fits into {max_bytes} bytes")
    return fits[0]


def read_pyramid(spark: SparkSession, folder: str, resolution_mm: float | None = None, box: Box | None = None, max_bytes: int = MAX_BYTES) -> tuple[Scale, DataFrame]:
    """The chosen scale and its voxels (x, y, z, value) in a box in mm; only blocks that the box touches are read."""
    rows = spark.read.parquet(f"{folder}/scales").collect()
    scale = choose([Scale(r.scale, r.resolution_mm, r.sx, r.sy, r.sz) for r in rows], resolution_mm, box, max_bytes)
    kinds = "x int, y int, z int, value double, bx int, by int, bz int"
    stored = spark.read.schema(kinds).parquet(f"{folder}/voxels/scale={scale.scale}")
    return scale, V.in_box(stored, *scale.voxels_of(box), rows[0].block).select(*XYZ, "value")
