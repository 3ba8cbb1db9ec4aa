"""Meshes as vertex rows (mesh, fragment, vid, x, y, z, label) and face rows (mesh, fragment, fid, v0, v1, v2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratlas.functions import geometry as G
from stratlas.operators.components import connected_components
from stratlas.session import materialise

MAX_ROUNDS = 60


def fragment(rows: DataFrame, name: str | None) -> DataFrame:
    """Rows of fragments whose name holds the given one; all without one."""
    return rows if name is None else rows.filter(F.contains(F.lower("fragment"), F.lit(name.lower())))


def label_mask(verts: DataFrame, label: int) -> DataFrame:
    return verts.withColumn("label", F.when(F.col("label") == label, 1).otherwise(0))


def clear_background(verts: DataFrame) -> DataFrame:
    """Surface annotations mark background by -1; it becomes 0."""
    return verts.withColumn("label", F.when(F.col("label") == -1, 0).otherwise(F.col("label")))


def merge(verts: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The fragments of each mesh as one: vertex numbers go on from fragment to fragment, and faces follow."""
    order = Window.partitionBy("mesh").orderBy("fragment").rowsBetween(Window.unboundedPreceding, -1)
    offset = verts.groupBy("mesh", "fragment").agg((F.max("vid") + 1).alias("_n")).withColumn("_o", F.coalesce(F.sum("_n").over(order), F.lit(0))).drop("_n")
    v = verts.join(offset, ["mesh", "fragment"]).withColumn("vid", F.col("vid") + F.col("_o")).drop("_o")
    f = faces.join(offset, ["mesh", "fragment"]).withColumns({c: F.col(c) + F.col("_o") for c in ("v0", "v1", "v2")}).drop("_o")
    return v, f


def _crossings(verts: DataFrame, faces: DataFrame, normal: tuple[float, float, float], d: float) -> DataFrame:
    """Faces that a plane crosses: (mesh, fid, a, b), each end with its edge, named by its two vertices, and the place."""
    p = verts.select("mesh", "vid", "x", "y", "z")
    x = faces
    for k in range(3):
        x = x.join(p.select("mesh", F.col("vid").alias(f"v{k}"), F.struct("x", "y", "z").alias(f"p{k}")), ["mesh", f"v{k}"])
    side = [G.sidedness(normal, d, F.col(f"p{k}.x"), F.col(f"p{k}.y"), F.col(f"p{k}.z")) for k in range(3)]
    x = x.withColumns({f"s{k}": s for k, s in enumerate(side)}).filter("s0 + s1 + s2 between 1 and 2")
    hits = []
    for i, j in ((0, 1), (1, 2), (0, 2)):
        ends = [[F.col(f"p{k}.{c}") for c in "xyz"] for k in (i, j)]
        edge = F.concat_ws("-", F.least(f"v{i}", f"v{j}").cast("string"), F.greatest(f"v{i}", f"v{j}").cast("string"))
        hits.append(F.when(F.col(f"s{i}") != F.col(f"s{j}"), F.struct(edge.alias("edge"), G.segment_hit(normal, d, *ends).alias("at"))))
    x = x.select("mesh", "fid", F.array_compact(F.array(*hits)).alias("h"))
    return x.select("mesh", "fid", F.get("h", F.lit(0)).alias("a"), F.get("h", F.lit(1)).alias("b"))


def plane_cut(verts: DataFrame, faces: DataFrame, normal: tuple[float, float, float], d: float) -> DataFrame:
    """Where faces cross a plane: rows (mesh, fid, contour, a and b as x, y, z), one segment each.

    Segments that share an edge belong to one contour, which is named by its
    smallest edge.  ``contours`` has their points in order.
    """
    x = _crossings(verts, faces, normal, d)
    name = lambda c: F.concat_ws(":", F.col("mesh").cast("string"), F.col(f"{c}.edge"))
    edges = x.select(name("a").alias("a"), name("b").alias("b"))
    found = connected_components(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct(), edges)
    return x.join(found, name("a") == F.col("id")).select("mesh", "fid", F.col("component").alias("contour"), F.col("a.at").alias("a"), F.col("b.at").alias("b"))


def _ranked(half: DataFrame) -> DataFrame:
    """Half segments (id, u, v, next) with ``left``, how many are from here to the end, and ``last``, the end and the segment there.

    Pointer jumping: each round every half segment takes on what its successor
    knows and points as far again, so rounds grow with the logarithm of the
    longest line.  A line that comes back to its start is opened at the smallest
    edge on it, which it learns in the same way.
    """
    state = materialise(half.select("id", "v", "next", F.lit(1).cast("long").alias("left"), F.struct("v", "id.fid").alias("last"), F.col("u").alias("least")))
    ends = None
    for _ in range(MAX_ROUNDS):
        done = state.filter("next is null").select("id", "left", "last")
        known = state.select(F.col("id").alias("next"), F.col("next").alias("n2"), F.col("left").alias("l2"), F.col("last").alias("e2"), F.col("least").alias("m2"))
        new = state.join(known, "next", "left").select("id", "v", F.col("n2").alias("next"), (F.col("left") + F.coalesce("l2", F.lit(0))).alias("left"), F.coalesce("e2", "last").alias("last"), F.least("least", F.coalesce("m2", "least")).alias("least"), (F.col("m2") < F.col("least")).alias("learned"))
        new = materialise(new)
        if new.filter("next is not null").isEmpty():
            return new.select("id", "left", "last") if ends is None else ends.union(new.select("id", "left", "last"))
        if ends is None and new.filter("next is not null and learned").isEmpty():
            # What still has a successor is closed, and knows its smallest edge.
            ends = new.filter("next is null").select("id", "left", "last")
            open_ = new.filter("next is not null").select("id", "least").join(half, "id").withColumn("next", F.when(F.col("v") != F.col("least"), F.col("next")))
            new = materialise(open_.select("id", "v", "next", F.lit(1).cast("long").alias("left"), F.struct("v", "id.fid").alias("last"), "least"))
        state = new.drop("learned")
    raise RuntimeError(f"lines are open after {MAX_ROUNDS} rounds")


def contours(verts: DataFrame, faces: DataFrame, normal: tuple[float, float, float], d: float) -> DataFrame:
    """The lines where meshes cross a plane, their points in order: (mesh, contour, k, x, y, z, fid, closed).

    fid is the face that leads from a point to the next one, null at the end of an
    open line; of a closed one the last point leads to the first.  A line starts at
    the end with the smaller edge (then face), a closed one at its smallest edge
    towards the smaller face, and is named by both.  Where more than two faces
    share an edge, lines end.
    """
    s = materialise(_crossings(verts, faces, normal, d))
    way = lambda w, u, v: s.select(F.struct("mesh", "fid", F.lit(w).alias("way")).alias("id"), "mesh", F.col(f"{u}.edge").alias("u"), F.col(f"{v}.edge").alias("v"), F.col(f"{u}.at").alias("from"), F.col(f"{v}.at").alias("to"))
    half = materialise(way(0, "a", "b").union(way(1, "b", "a")))
    pairs = half.groupBy("mesh", "u").agg(F.count("*").alias("n")).filter("n = 2").drop("n")
    leave = half.join(pairs, ["mesh", "u"]).select("mesh", F.col("u").alias("v"), F.col("id").alias("next"))
    follow = half.select("mesh", "v", "id").join(leave, ["mesh", "v"]).filter("id.fid <> next.fid").select("id", "next")
    half = materialise(half.join(follow, "id", "left"))
    ranked = _ranked(half.select("id", "u", "v", "next"))
    twin = ranked.select(F.struct("id.mesh", "id.fid", (1 - F.col("id.way")).alias("way")).alias("id"), (F.col("left") - 1).alias("k"), F.col("last").alias("first"))
    line = half.join(ranked, "id").join(twin, "id").filter("first < last")
    name = F.concat_ws("/", "first.v", F.col("first.fid").cast("string")).alias("contour")
    closed = F.col("first.v") == F.col("last.v")
    here = F.struct("k", F.col("from").alias("at"), F.col("id.fid").alias("fid"))
    end = F.struct((F.col("k") + 1).alias("k"), F.col("to").alias("at"), F.lit(None).cast(faces.schema["fid"].dataType).alias("fid"))
    points = F.when((F.col("left") == 1) & ~closed, F.array(here, end)).otherwise(F.array(here))
    return line.select("mesh", name, F.explode(points).alias("p"), closed.alias("closed")).select("mesh", "contour", "p.k", "p.at.x", "p.at.y", "p.at.z", "p.fid", "closed")
