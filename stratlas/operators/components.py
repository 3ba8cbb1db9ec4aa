"""Connected components of voxel masks and of general graphs, by joins."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratlas.operators import locations
from stratlas.operators.voxels import XYZ
from stratlas.session import materialise

MAX_ROUNDS = 60
SIDE = 1 << 20


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that the edges (a, b) reach from each node.

    Each round takes the smallest label among neighbours and then the label of
    that label (pointer jumping), so the rounds grow with the logarithm of the
    longest path.  An end without convergence is an error, never a wrong result.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    label = materialise(nodes.select("id", F.col("id").alias("component")))
    for _ in range(MAX_ROUNDS):
        seen = both.join(label.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        # A label hands on what it heard to the node it names, so whole trees hook onto smaller ones.
        heard = label.join(seen, "id").filter("c < component").select("component", "c").groupBy("component").agg(F.min("c").alias("c2")).select(F.col("component").alias("id"), "c2")
        low = label.join(seen, "id", "left").join(heard, "id", "left").select("id", F.least("component", F.coalesce("c", "component"), F.coalesce("c2", "component")).alias("component"))
        up = low.select(F.col("id").alias("component"), F.col("component").alias("top"))
        new = materialise(low.join(up, "component").select("id", F.least("component", "top").alias("component"), "top"))
        changed = new.select("id", "component").join(label.withColumnRenamed("component", "old"), "id").filter("component <> old")
        done = changed.isEmpty()
        label = new.select("id", "component")
        if done:
            return label
    raise RuntimeError(f"components still change after {MAX_ROUNDS} rounds")


def neighbours(connectivity: int) -> list[tuple[int, int, int]]:
    """Half of the offsets of voxels that share a face (1), an edge (2) or a corner (3)."""
    return [o for o in product((-1, 0, 1), repeat=3) if (0, 0, 0) < o and sum(map(abs, o)) <= connectivity]


def label_mask(voxels: DataFrame, connectivity: int = 2) -> DataFrame:
    """Mask voxels with the component they belong to, named by its smallest voxel id.

    Places count from zero, or from the smallest coordinate of an axis where that
    is negative; ``SIDE`` of them make an id, and masks that are longer are refused.
    """
    mask = materialise(voxels.filter("value <> 0").select(*[F.col(c).cast("long").alias(c) for c in XYZ]).distinct())
    ends = mask.agg(*[F.least(F.min(c), F.lit(0)).alias(c) for c in XYZ], *[F.max(c).alias("_" + c) for c in XYZ]).first()
    for c in XYZ:
        if ends[c] is not None and ends["_" + c] - ends[c] >= SIDE - 1:  # one place is left free between rows
            raise ValueError(f"the mask's {c} goes from {ends[c]} to {ends['_' + c]}; {SIDE - 2} places at most")
    x, y, z = (F.col(c) - F.lit(ends[c] or 0) for c in XYZ)
    mask = mask.withColumn("id", (x * (1 << 40) + y * (1 << 20) + z).cast("long"))
    steps = F.array(*[F.col("id") + F.lit((i << 40) + (j << 20) + k).cast("long") for i, j, k in neighbours(connectivity)])
    edges = mask.select(F.col("id").alias("a"), F.explode(steps).alias("b")).join(mask.select(F.col("id").alias("b")), "b", "left_semi")
    return mask.join(connected_components(mask, edges), "id").select(*[F.col(c).cast("int").alias(c) for c in XYZ], "component")


def squared_distance(voxels: DataFrame) -> DataFrame:
    """Mask voxels with the squared Euclidean distance to the nearest voxel outside: the weight with which places in a mask are sampled.

    The nearest one outside always has a face in common with the mask, so only
    those are looked through.
    """
    mask = materialise(voxels.filter("value <> 0").select(*[F.col(c).cast("int").alias(c) for c in XYZ]).distinct())
    steps = [*neighbours(1), *[tuple(-v for v in o) for o in neighbours(1)]]
    around = F.explode(F.array(*[F.struct(*[(F.col(c) + v).alias(c) for c, v in zip(XYZ, o, strict=True)]) for o in steps]))
    edge = materialise(mask.select(around.alias("e")).select("e.*").distinct().join(mask, list(XYZ), "left_anti"))
    keyed = lambda df, name: df.select(F.struct(*XYZ).alias(name), *[F.col(c).cast("double").alias(c) for c in XYZ])
    got = locations.nearest(keyed(mask, "at"), keyed(edge, "to"), "at", "to", 2.0)
    return got.select("at.*", F.round(F.col("distance") * F.col("distance")).cast("long").alias("squared"))


def distance_to_background(voxels: DataFrame, limit: int = 200) -> DataFrame:
    """Mask voxels with the number of face-neighbour layers that have to be taken off to reach them, by peeling."""
    left = materialise(voxels.filter("value <> 0").select(*XYZ).distinct())
    out = None
    for depth in range(1, limit + 1):
        steps = [*neighbours(1), *[tuple(-v for v in o) for o in neighbours(1)]]
        around = left.select(*[F.col(c).alias("_" + c) for c in XYZ], F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(o, "ijk", strict=True)]) for o in steps])).alias("o"))
        around = around.select("_x", "_y", "_z", (F.col("_x") + F.col("o.i")).alias("x"), (F.col("_y") + F.col("o.j")).alias("y"), (F.col("_z") + F.col("o.k")).alias("z"))
        inner = around.join(left, list(XYZ), "left_semi").groupBy("_x", "_y", "_z").count().filter("count = 6").select(*[F.col("_" + c).alias(c) for c in XYZ])
        inner = materialise(inner)
        layer = left.join(inner, list(XYZ), "left_anti").withColumn("depth", F.lit(depth))
        out = layer if out is None else out.union(layer)
        if inner.isEmpty():
            return out
        left = inner
    raise RuntimeError(f"the mask is deeper than {limit} voxels")
