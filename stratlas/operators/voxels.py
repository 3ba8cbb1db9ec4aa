"""Volumes as tables of nonzero voxels (map_id, volume, fragment, x, y, z, value) and their algebra.

Background is the absence of a row.  All operators are filters, equi-joins on
the voxel's place or aggregations by it, which spread over any number of tasks;
none looks at a volume as one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratlas.functions import geometry as G

XYZ = ("x", "y", "z")
#: Edge of a storage block, a partition column of stored voxel tables.
BLOCK = 64


def select(voxels: DataFrame, label: float | None = None, fragment: str | None = None, threshold: float | None = None, volume: int | None = None) -> DataFrame:
    """A filtered view: one label as a mask, one fragment, or a mask of values over a threshold."""
    if volume is not None:
        voxels = voxels.filter(F.col("volume") == volume)
    if fragment is not None:
        voxels = voxels.filter(F.lower("fragment").contains(fragment.lower()))
    if label is not None:
        voxels = voxels.filter(F.col("value") == label).withColumn("value", F.lit(1.0))
    if threshold is not None:
        voxels = voxels.filter(F.col("value") > threshold).withColumn("value", F.lit(1.0))
    return voxels


def with_blocks(voxels: DataFrame, size: int = BLOCK) -> DataFrame:
    """Voxels with their block's columns, to be written partitioned by them."""
    return voxels.withColumns({f"b{c}": F.floor(F.col(c) / size).cast("int") for c in XYZ})


def in_box(voxels: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int], size: int = BLOCK) -> DataFrame:
    """Voxels with low <= place < high; on a blocked table the block columns prune partitions first."""
    for c, a, b in zip(XYZ, low, high, strict=True):
        if f"b{c}" in voxels.columns:
            voxels = voxels.filter(F.col(f"b{c}").between(a // size, (b - 1) // size))
        voxels = voxels.filter((F.col(c) >= a) & (F.col(c) < b))
    return voxels


def labelled_map(volume: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A map from one volume and (label, region) rows: its voxels with their region, and the labels that no region has, with their voxels' number."""
    known = volume.join(regions.select(F.col("label").cast("double").alias("value"), "region"), "value")
    return known, volume.join(regions.select(F.col("label").cast("double").alias("value")), "value", "left_anti").groupBy("value").agg(F.count("*").alias("voxels"))


def region_in_box(sources: DataFrame, masks: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int], id: str = "id") -> DataFrame:
    """(id, x, y, z): what of every region's mask lies in a box; ``sources`` (id, source) says what a region's mask is made of."""
    return sources.join(in_box(masks, low, high), "source").select(id, *XYZ).distinct()


def slice_4d(voxels: DataFrame, t: int) -> DataFrame:
    return voxels.filter(F.col("t") == t).drop("t")


def voxel_of(points: DataFrame, to_voxel: G.Matrix, half: bool = True) -> DataFrame:
    """Points with the voxel (vx, vy, vz) they are in: truncated after adding a half, or plainly truncated."""
    got = G.transform(to_voxel, *[F.col(c).cast("double") for c in XYZ])
    return points.withColumns({"v" + c: (g + (0.5 if half else 0.0)).cast("int") for c, g in zip(XYZ, got, strict=True)})


def _at(points: DataFrame, voxels: DataFrame) -> list[Column]:
    return [points["v" + c] == voxels[c] for c in XYZ]


def read(points: DataFrame, voxels: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Points (with vx, vy, vz) joined to every volume's value over the threshold at their voxel."""
    v = voxels.filter(F.col("value") > threshold).select("map_id", "volume", "fragment", *[F.col(c).alias("_" + c) for c in XYZ], "value")
    return points.join(v, [F.col("v" + c) == F.col("_" + c) for c in XYZ]).drop(*["_" + c for c in XYZ])


def points_inside(points: DataFrame, voxels: DataFrame) -> DataFrame:
    """The points (with vx, vy, vz) whose voxel is in the mask."""
    mask = voxels.filter("value > 0").select(*[F.col(c).alias("v" + c) for c in XYZ])
    return points.join(mask, ["v" + c for c in XYZ], "left_semi")


def evaluate(points: DataFrame, voxels: DataFrame, outside: float = 0.0) -> DataFrame:
    """Points with the value at their voxel; voxels of index 0 count as outside."""
    v = voxels.filter("x > 0 and y > 0 and z > 0").select(*[F.col(c).alias("v" + c) for c in XYZ], "value")
    return points.join(v, ["v" + c for c in XYZ], "left").withColumn("value", F.coalesce("value", F.lit(outside)))


def minimum(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pointwise minimum of two volumes of one grid."""
    other = b.select(*XYZ, F.col("value").alias("_v"))
    return a.select(*XYZ, "value").join(other, list(XYZ)).select(*XYZ, F.least("value", "_v").alias("value")).filter("value <> 0")


def bounding_box(voxels: DataFrame, *by: str) -> DataFrame:
    """The box of nonzero voxels, upper ends one beyond the last voxel."""
    return voxels.filter("value <> 0").groupBy(*by).agg(*[F.min(c).alias(c + "0") for c in XYZ], *[(F.max(c) + 1).alias(c + "1") for c in XYZ])


def spatial_props(voxels: DataFrame, affine: G.Matrix, *by: str) -> DataFrame:
    """Centroid (mm) and volume of each group (of components, say), largest first."""
    got = voxels.filter("value <> 0").groupBy(*by).agg(*[F.avg(c).alias(c) for c in XYZ], F.count("*").alias("voxels"))
    place = G.transform(affine, *map(F.col, XYZ))
    return got.withColumns(dict(zip(XYZ, place, strict=True))).withColumn("volume", F.col("voxels") * G.affine_scaling(affine)).orderBy(F.desc("volume"), *by)


def argmax(voxels: DataFrame, *by: str, label: str = "label", value: str = "value") -> DataFrame:
    """Per voxel the label of the largest value, the smallest label of several: a labelled map of a statistical one."""
    return voxels.filter(F.col(value) > 0).groupBy(*by, *XYZ).agg(F.max_by(label, F.struct(value, -F.col(label))).alias(label), F.max(value).alias(value))


def compress(voxels: DataFrame) -> DataFrame:
    """Statistical volumes as one labelled volume; labels number the volumes from 1."""
    return argmax(voxels.withColumn("label", F.col("volume") + 1)).select(*XYZ, F.col("label").alias("value"))


def relabel(index: DataFrame) -> DataFrame:
    """Regions of a map index with labels in sequence from 1, by volume, fragment and old label."""
    return index.withColumn("new_label", F.dense_rank().over(Window.partitionBy("map_id").orderBy("volume", "fragment", "label")))


def merge(voxels: DataFrame, order: str = "volume") -> DataFrame:
    """Nonzero voxels of several volumes as one, later ones over earlier ones; n_writers tells of conflicts."""
    return voxels.filter("value <> 0").groupBy(*XYZ).agg(F.max_by("value", order).alias("value"), F.count("*").alias("n_writers"))


def resample_nearest(voxels: DataFrame, source: G.Matrix, target: G.Matrix) -> DataFrame:
    """A mask or labels on a grid at least as coarse: each voxel goes to its nearest place there, the largest value stays."""
    got = G.transform(G.compose(G.inverse(target), source), *map(F.col, XYZ))
    moved = voxels.select(*[F.floor(g + 0.5).cast("int").alias(c) for c, g in zip(XYZ, got, strict=True)], "value")
    return moved.groupBy(*XYZ).agg(F.max("value").alias("value"))


def resample_linear(voxels: DataFrame, source: G.Matrix, target: G.Matrix) -> DataFrame:
    """Values on another grid by trilinear weights of the eight source voxels around each target place.

    Every source voxel is sent to the target places within one source voxel of
    it, found from the box that one source voxel spans in the target grid, so
    the work is in proportion to nonzero voxels.
    """
    forth, back = G.compose(G.inverse(target), source), G.compose(G.inverse(source), target)
    reach = [sum(abs(forth[i][j]) for j in range(3)) for i in range(3)]
    got = G.transform(forth, *map(F.col, XYZ))
    out = voxels.select(*[F.col(c).alias("_" + c) for c in XYZ], *[g.alias("g" + c) for c, g in zip(XYZ, got, strict=True)], "value")
    for c, r in zip(XYZ, reach, strict=True):
        out = out.withColumn(c, F.explode(F.sequence(F.ceil(F.col("g" + c) - r).cast("int"), F.floor(F.col("g" + c) + r).cast("int"))))
    at = G.transform(back, *map(F.col, XYZ))
    weight = F.lit(1.0)
    for c, p in zip(XYZ, at, strict=True):
        weight = weight * F.greatest(F.lit(0.0), 1 - F.abs(p - F.col("_" + c)))
    return out.withColumn("_w", weight).filter("_w > 0").groupBy(*XYZ).agg(F.sum(F.col("_w") * F.col("value")).alias("value")).filter("value <> 0")


def density(points: DataFrame, sigma: float, reach: float = 3) -> DataFrame:
    """Points (x, y, z ints) as a density that sums to 1: counts per voxel, spread by a Gaussian kernel."""
    r, whole = G.gaussian_line(sigma, reach)
    spread = counts = points.groupBy(*XYZ).agg(F.count("*").alias("n"))
    spread = spread.withColumn("n", F.col("n").cast("double"))
    for axis in XYZ:  # the kernel is a product of three, so each pass sends a voxel to 2 r + 1 places of one axis
        weight = F.exp(F.col("_o") * F.col("_o") / (-2 * sigma * sigma)) / whole
        spread = spread.withColumn("_o", F.explode(F.sequence(F.lit(-r), F.lit(r)))).groupBy(*[(F.col(c) + F.col("_o")).alias(c) if c == axis else F.col(c) for c in XYZ]).agg(F.sum(F.col("n") * weight).alias("n"))
    total = counts.agg(F.sum("n").alias("_n"))
    return spread.join(F.broadcast(total), F.lit(True)).select(*XYZ, (F.col("n") / F.col("_n")).alias("value"))


def colorize(voxels: DataFrame, index: DataFrame, values: DataFrame) -> DataFrame:
    """Each voxel painted with its region's value; where regions overlap, the one of the largest map value."""
    painted = index.join(values, "region").select("map_id", "volume", "label", F.col("value").alias("paint"))
    v = voxels.alias("v").join(painted.alias("p"), (F.col("v.map_id") == F.col("p.map_id")) & (F.col("v.volume") == F.col("p.volume")) & (F.col("p.label").isNull() | (F.col("p.label") == F.col("v.value"))))
    return v.groupBy(*[F.col("v." + c).alias(c) for c in XYZ]).agg(F.max_by("p.paint", F.struct("v.value", "p.paint")).alias("value"))


def region_mask(voxels: DataFrame, index: DataFrame, regions: DataFrame, threshold: float = 0.0) -> DataFrame:
    """The voxels of any of the given regions (a region and its descendants) as one mask."""
    wanted = index.join(regions.select("region").distinct(), "region", "left_semi").select("map_id", F.col("volume").alias("_v"), "label").distinct()
    hit = voxels.join(wanted, (voxels["map_id"] == wanted["map_id"]) & (voxels["volume"] == F.col("_v")) & (F.col("label").isNull() | (F.col("label") == F.col("value"))), "left_semi")
    return hit.filter(F.col("value") > threshold).select(*XYZ).distinct().withColumn("value", F.lit(1.0))


def local_peaks(voxels: DataFrame, distance: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Voxels that no voxel of their group within the (Chebyshev) distance exceeds; of equal ones the first in x, y, z."""
    around = voxels.select(*[F.col(c).alias("g" + c) for c in by], *[F.col(c).alias("_" + c) for c in XYZ], F.col("value").alias("_v"))
    for c in XYZ:
        around = around.withColumn("n" + c, F.explode(F.sequence(F.col("_" + c) - distance, F.col("_" + c) + distance)))
    best = around.groupBy(*["g" + c for c in by], "nx", "ny", "nz").agg(F.max(F.struct("_v", (-F.col("_x")).alias("i"), (-F.col("_y")).alias("j"), (-F.col("_z")).alias("k"))).alias("b"))
    here = (F.col("x") == F.col("nx")) & (F.col("y") == F.col("ny")) & (F.col("z") == F.col("nz"))
    for c in by:
        here = here & F.col(c).eqNullSafe(F.col("g" + c))
    own = (F.col("b")["_v"] == F.col("value")) & (F.col("b")["i"] == -F.col("x")) & (F.col("b")["j"] == -F.col("y")) & (F.col("b")["k"] == -F.col("z"))
    return voxels.join(best, here).filter(own).select(*by, *XYZ, "value")


def draw(voxels: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` voxels drawn with replacement, chances as values.

    The values' running sums (by place, in hash ranges summed first) divide the
    whole into stretches, and each of ``n`` even draws with a random start in its
    step falls into one stretch; a heavy voxel gets several.
    """
    v = voxels.filter("value > 0").select(*XYZ, "value").withColumn("b", F.pmod(F.xxhash64(*XYZ), F.lit(4096)))
    sums = v.groupBy("b").agg(F.sum("value").alias("s"))
    before = Window.partitionBy(F.lit(0)).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy(F.lit(0))
    sums = sums.select("b", F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("o"), F.sum("s").over(total).alias("t"))
    order = Window.partitionBy("b").orderBy(*XYZ).rowsBetween(Window.unboundedPreceding, 0)
    v = v.withColumn("c", F.sum("value").over(order)).join(F.broadcast(sums), "b")
    start = F.pmod(F.xxhash64(F.lit(seed)), F.lit(1_000_003)) / 1_000_003
    hi = F.ceil((F.col("o") + F.col("c")) * n / F.col("t") - start)
    lo = F.ceil((F.col("o") + F.col("c") - F.col("value")) * n / F.col("t") - start)
    return v.withColumn("k", F.greatest(hi - lo, F.lit(0))).filter("k > 0").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k")))).select(*XYZ, "value")
