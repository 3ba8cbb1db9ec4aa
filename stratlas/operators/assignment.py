"""Assignment of points and images to the regions of a map; one fixed schema of twelve columns.

Qualifications are coded 1 EXACT, 2 APPROXIMATE, 3 OTHER_VERSION, 4 CONTAINED,
5 CONTAINS, 6 OVERLAPS, 7 HOMOLOGOUS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratlas.functions import geometry as G
from stratlas.operators import components, locations, similarity, voxels as V
from stratlas.session import materialise

XYZ = ("x", "y", "z")
# Codes and verbs of qualifications.
CODES = {"EXACT": 1, "APPROXIMATE": 2, "OTHER_VERSION": 3, "CONTAINED": 4, "CONTAINS": 5, "OVERLAPS": 6, "HOMOLOGOUS": 7}
VERBS = {1: "coincides with", 2: "approximates to", 3: "is another version of", 4: "is contained in", 5: "contains", 6: "overlaps with", 7: "is homologous to"}
_INVERSE = {4: 5, 5: 4}
#: Voxels of uncertainty from which a point is a blob.
BLOB = 3

# The columns of an assignment, in their order.
COLUMNS = ("input_structure", "centroid", "volume", "fragment", "region", "correlation", "intersection_over_union", "map_value", "map_weighted_mean", "map_containedness", "input_weighted_mean", "input_containedness")


def verb(code: Column) -> Column:
    return F.create_map(*[x for k, v in VERBS.items() for x in (F.lit(k), F.lit(v))])[code]


def invert(code: Column) -> Column:
    """The qualification as seen from the other side."""
    out = code
    for a, b in _INVERSE.items():
        out = F.when(code == a, F.lit(b)).otherwise(out)
    return out


def describe(query: Column, code: Column, assigned: Column) -> Column:
    return F.concat_ws(" ", query, verb(code), assigned)


def with_regions(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Voxel reads (map_id, volume, fragment, value) with the region their index means; labels compare to values."""
    i = index.select(F.col("map_id").alias("_m"), F.col("volume").alias("_v"), F.col("fragment").alias("_f"), F.col("label").alias("_l"), "region")
    on = (F.col("map_id") == F.col("_m")) & (F.col("volume") == F.col("_v")) & F.col("fragment").eqNullSafe(F.col("_f")) & (F.col("_l").isNull() | (F.col("_l") == F.col("value")))
    return rows.join(i, on).drop("_m", "_v", "_f", "_l")


def _shaped(rows: DataFrame, **given: Column) -> DataFrame:
    kinds = {"input_structure": "long", "centroid": "array<double>", "volume": "int", "fragment": "string", "region": "string"}
    return rows.select(*[given.get(c, F.lit(None)).cast(kinds.get(c, "double")).alias(c) for c in COLUMNS])


def assign_points(points: DataFrame, table: DataFrame, index: DataFrame, to_voxel: G.Matrix, id: str = "idx", threshold: float = 0.0) -> DataFrame:
    """Certain points: every region whose map has a value over the threshold at the point's voxel."""
    got = with_regions(V.read(V.voxel_of(points, to_voxel), table, threshold), index)
    return _shaped(got, input_structure=F.col(id), centroid=F.array(*XYZ), volume=F.col("volume"), fragment=F.col("fragment"), region=F.col("region"), map_value=F.col("value"))


def assign_uncertain(points: DataFrame, table: DataFrame, index: DataFrame, to_voxel: G.Matrix, sigma_voxels: float | str, id: str = "idx", threshold: float = 0.0) -> DataFrame:
    """Points with one uncertainty or (a column's name) one each.

    Below ``BLOB`` voxels a point is read at its voxel, as a certain one; any other
    is a Gaussian blob, compared to every region it meets, where the threshold is
    on the intersection over union.  A blob's own sums come from its uncertainty, so
    it is spread over the map's box only.
    """
    p = points.withColumn("_s", F.coalesce(F.col(sigma_voxels) if isinstance(sigma_voxels, str) else F.lit(sigma_voxels), F.lit(0.0)).cast("double"))
    certain = assign_points(p.filter(F.col("_s") < BLOB), table, index, to_voxel, id, threshold)

    s = F.col("_s")
    p = V.voxel_of(p.filter(s >= BLOB), to_voxel).withColumn("_r", (3 * s).cast("int"))
    line = F.transform(F.sequence(-F.col("_r"), F.col("_r")), lambda i: F.exp(-(i * i) / (2 * s * s)))
    p = p.withColumn("_line", line).withColumns({"_l1": F.aggregate("_line", F.lit(0.0), lambda a, w: a + w), "_l2": F.aggregate("_line", F.lit(0.0), lambda a, w: a + w * w)})
    side = 2 * F.col("_r") + 1
    ends = [(F.col("v" + c) + sign * F.col("_r")).alias(f"b_{c}{i}") for c in XYZ for i, sign in enumerate((-1, 1))]
    own = p.select(F.col(id).alias("q"), F.pow(side, 3).cast("long").alias("n_b"), F.lit(1.0).alias("s_b"), F.pow(F.col("_l2") / (F.col("_l1") * F.col("_l1")), 3).alias("ss_b"), F.pow(F.col("_l1"), -3).alias("max_b"), *ends)

    box = table.filter("value > 0").agg(*[f(c).alias(f"_{c}{i}") for c in XYZ for i, f in enumerate((F.min, F.max))])
    blob = p.select(F.col(id).alias("point"), *["v" + c for c in XYZ], "_r", "_s", "_l1").join(F.broadcast(box), F.lit(True))
    for c in XYZ:
        first, last = F.greatest(F.col("v" + c) - F.col("_r"), F.col(f"_{c}0")), F.least(F.col("v" + c) + F.col("_r"), F.col(f"_{c}1"))
        blob = blob.withColumn(c, F.explode(F.when(first <= last, F.sequence(first, last))))
    away = sum(((F.col(c) - F.col("v" + c)) * (F.col(c) - F.col("v" + c)) for c in XYZ), F.lit(0))
    blob = blob.select("point", *XYZ, (F.exp(-away / (2 * s * s)) / F.pow(F.col("_l1"), 3)).alias("value"))
    place = p.select(F.col(id).alias("point"), F.array(*[F.col(c).cast("double") for c in XYZ]).alias("centroid"))
    return certain.union(_compared(blob, "point", table, index, place, own).filter(F.col("intersection_over_union") > threshold))


def assign_image(image: DataFrame, table: DataFrame, index: DataFrame, min_voxels: int = 1, connectivity: int = 2) -> DataFrame:
    """An image in the map's grid: its connected components of more than ``min_voxels`` voxels, each compared to every region it meets."""
    labelled = components.label_mask(image, connectivity)
    large = labelled.groupBy("component").count().filter(F.col("count") > min_voxels)
    parts = labelled.join(large, "component", "left_semi").join(image.select(*XYZ, "value"), list(XYZ))
    return _compared(parts, "component", table, index)


def _compared(parts: DataFrame, by: str, table: DataFrame, index: DataFrame, place: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    named = with_regions(table, index).select(F.struct("map_id", "volume", "fragment", "region").alias("of"), *XYZ, "value")
    got = similarity.compare_across(named, parts, "of", by, own)
    if place is None:
        place = parts.groupBy(by).agg(F.array(*[F.avg(c) for c in XYZ]).alias("centroid"))
    return _shaped(
        got.join(place, by),
        input_structure=F.col(by),
        centroid=F.col("centroid"),
        volume=F.col("of.volume"),
        fragment=F.col("of.fragment"),
        region=F.col("of.region"),
        correlation=F.col("correlation"),
        intersection_over_union=F.col("iou"),
        map_value=F.col("map_value"),
        map_weighted_mean=F.col("map_weighted_mean"),
        map_containedness=F.col("map_contained"),
        input_weighted_mean=F.col("input_weighted_mean"),
        input_containedness=F.col("input_contained"),
    )


def assign_regions(a: DataFrame, b: DataFrame, a_id: str, b_id: str, a_boxes: DataFrame | None = None, b_boxes: DataFrame | None = None) -> DataFrame:
    """How the regions of two maps lie to one another: (a_id, b_id, qualification, shared, by), pairs that meet.

    ``a`` and ``b`` are masks of one grid (id, x, y, z).  A pair with equal masks is
    EXACT, a mask in the other CONTAINED, the other way round CONTAINS, else they
    OVERLAP; ``shared`` counts the voxels of both.  A region without a mask may have
    a box (id, x0 to z1 in voxels, upper ends one beyond the last): its pairs are
    told from the two boxes, with ``shared`` null and ``by`` "box" instead of "mask".
    A region with a mask doesn't need its box.  Repeated voxels count once, and rows
    without an id or place are left out.

    Places are grouped by the set of regions that they belong to before any pair is
    made, so pairs are counted per set and not per voxel.
    """
    side = lambda df, id, n: df.dropna(subset=[id, *XYZ]).select(*XYZ, *[(F.col(id) if i == n else F.lit(None).cast((a.schema[a_id], b.schema[b_id])[i].dataType)).alias("ab"[i]) for i in (0, 1)])
    a, b = a.select(a_id, *XYZ), b.select(b_id, *XYZ)
    sets = side(a, a_id, 0).union(side(b, b_id, 1)).groupBy(*XYZ).agg(F.sort_array(F.collect_set("a")).alias("sa"), F.sort_array(F.collect_set("b")).alias("sb"))
    sets = materialise(sets.groupBy("sa", "sb").agg(F.count("*").alias("n")))
    own = [sets.select(F.explode("s" + c).alias(c), "n").groupBy(c).agg(F.sum("n").alias("n" + c)) for c in "ab"]
    met = sets.withColumn("a", F.explode("sa")).withColumn("b", F.explode("sb")).groupBy("a", "b").agg(F.sum("n").alias("shared"))
    met = met.join(own[0], "a").join(own[1], "b")
    whole = [F.col("shared") == F.col("n" + c) for c in "ab"]
    how = F.when(whole[0] & whole[1], "EXACT").when(whole[0], "CONTAINED").when(whole[1], "CONTAINS").otherwise("OVERLAPS")
    out = met.select(F.col("a").alias(a_id), F.col("b").alias(b_id), how.alias("qualification"), "shared", F.lit("mask").alias("by"))
    if a_boxes is None and b_boxes is None:
        return out

    def boxed(mask: DataFrame, id: str, given: DataFrame | None, ends: str) -> DataFrame:
        box = mask.dropna(subset=[id, *XYZ]).groupBy(id).agg(*[F.min(c).cast("double").alias(c + "0") for c in XYZ], *[(F.max(c) + 1).cast("double").alias(c + "1") for c in XYZ], F.lit(True).alias("has" + ends))
        if given is None:
            return box
        rest = given.join(box.select(id), id, "left_anti").select(id, *[F.col(c).cast("double").alias(c) for c in (*locations.LOW, *locations.HIGH)], F.lit(False).alias("has" + ends))
        return box.unionByName(rest)

    left, right = materialise(boxed(a, a_id, a_boxes, "")), materialise(boxed(b, b_id, b_boxes, "_b"))
    pairs = locations.intersect_boxes(left.drop("has"), right.drop("has_b"), a_id, b_id).select(a_id, b_id)
    full = pairs.join(left, a_id).join(right.select(b_id, "has_b", *[F.col(c).alias(c + "_b") for c in (*locations.LOW, *locations.HIGH)]), b_id)
    return out.union(full.filter(~(F.col("has") & F.col("has_b"))).select(a_id, b_id, locations.relation().alias("qualification"), F.lit(None).cast("long").alias("shared"), F.lit("box").alias("by")))
