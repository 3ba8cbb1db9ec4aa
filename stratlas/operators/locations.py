"""Points, clouds and boxes: joins by place, set operations and transforms.

Boxes are rows (x0, y0, z0, x1, y1, z1), points rows (x, y, z).  Joins by place
are equi-joins on grid cells, checked exactly afterwards.  Cells come in levels,
twice as large each; a box is filed at the level of its own side, so it lies in
eight cells at most and a box around everything shares no cell with small ones.
Boxes of less than 2^-``LEVELS`` of the largest are filed at the lowest level, so
there are few levels.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratlas.functions import geometry as G
from stratlas.session import materialise

LOW, HIGH = ("x0", "y0", "z0"), ("x1", "y1", "z1")
XYZ = ("x", "y", "z")


LEVELS = 20


def _side() -> Column:
    return F.greatest(*[F.col(b) - F.col(a) for a, b in zip(LOW, HIGH, strict=True)])


def _lowest(*boxes: DataFrame) -> int:
    """The lowest level in use: the largest box's, less ``LEVELS``."""
    sides = [b.agg(F.max(_side())).first()[0] for b in boxes]
    return math.ceil(math.log2(max([s for s in sides if s] or [1.0]))) - LEVELS


def _own_level(lowest: int) -> Column:
    """The smallest level whose cells are at least as large as the box."""
    return F.greatest(F.ceil(F.log2(F.when(_side() > 0, _side()))).cast("int"), F.lit(lowest))


def _levels(lowest: int, *boxes: DataFrame) -> list[int]:
    """The levels at which boxes are filed, ``LEVELS`` + 1 at most."""
    return sorted({r[0] for b in boxes for r in b.select(_own_level(lowest)).distinct().collect()})


def _cell(c: Column, level: Column) -> Column:
    return F.floor(c / F.pow(F.lit(2.0), level))


def _box_cells(boxes: DataFrame) -> DataFrame:
    """The cells (c0, c1, c2) of boxes at their ``level``."""
    for i, (a, b) in enumerate(zip(LOW, HIGH, strict=True)):
        boxes = boxes.withColumn(f"c{i}", F.explode(F.sequence(_cell(F.col(a), F.col("level")), _cell(F.col(b), F.col("level")))))
    return boxes


def points_in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points with the boxes that hold them, faces included."""
    lowest = _lowest(boxes)
    cells = _box_cells(boxes.withColumn("level", _own_level(lowest)))
    p = points.withColumn("p", F.explode(F.array(*[F.lit(v) for v in _levels(lowest, boxes)]).cast("array<int>")))
    for i, c in enumerate(XYZ):
        p = p.withColumn(f"p{i}", _cell(F.col(c), F.col("p")))
    on = [F.col("p") == F.col("level")] + [F.col(f"p{i}") == F.col(f"c{i}") for i in range(3)] + [(F.col(c) >= F.col(a)) & (F.col(c) <= F.col(b)) for c, a, b in zip(XYZ, LOW, HIGH, strict=True)]
    return p.join(cells, on).drop("p", "p0", "p1", "p2", "level", "c0", "c1", "c2")


def intersect_boxes(a: DataFrame, b: DataFrame, a_id: str, b_id: str, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of boxes that share more than a face and agree in the columns ``on``, with the box they share: (a_id, b_id, x0 .. z1).

    A pair meets at the level of its larger box, where the smaller one, which is
    filed at all levels from its own up, has eight cells at most too.
    """
    lowest = _lowest(a, b)
    names = {c: c + "_b" for c in (*LOW, *HIGH)}
    a, b = a.select(F.col(a_id).alias("_a"), *on, *LOW, *HIGH).withColumn("own", _own_level(lowest)), b.select(F.col(b_id).alias("_b"), *on, *LOW, *HIGH).withColumn("own", _own_level(lowest))
    levels = F.array(*[F.lit(v) for v in _levels(lowest, a, b)]).cast("array<int>")
    own, up = F.array("own"), F.filter(levels, lambda v: v > F.col("own"))
    filed = lambda boxes, at: _box_cells(boxes.withColumn("level", F.explode(at)))
    pairs = [(own, F.concat(own, up)), (up, own)]
    both = None
    for x, y in pairs:
        met = filed(a, x).drop("own").join(filed(b, y).drop("own").withColumnsRenamed(names), [*on, "level", "c0", "c1", "c2"])
        both = met if both is None else both.unionByName(met)
    shared = {lo: F.greatest(F.col(lo), F.col(names[lo])) for lo in LOW} | {hi: F.least(F.col(hi), F.col(names[hi])) for hi in HIGH}
    # A pair meets in every cell that both cover; it counts in the one that holds the shared box's lower corner.
    here = [_cell(shared[lo], F.col("level")) == F.col(f"c{i}") for i, lo in enumerate(LOW)]
    over = [shared[lo] < shared[hi] for lo, hi in zip(LOW, HIGH, strict=True)]
    cond = here[0]
    for c in here[1:] + over:
        cond = cond & c
    return both.filter(cond).select(F.col("_a").alias(a_id), F.col("_b").alias(b_id), *[v.alias(k) for k, v in shared.items()])


def relation(a: str = "", b: str = "_b") -> Column:
    """EXACT, CONTAINED, CONTAINS, OVERLAPS or null of box columns with suffix ``a`` to those with suffix ``b``."""
    lo, hi = (lambda s: [F.col(c + s) for c in LOW]), (lambda s: [F.col(c + s) for c in HIGH])
    every = lambda xs: xs[0] & xs[1] & xs[2]
    inside = lambda s, t: every([x >= y for x, y in zip(lo(s), lo(t), strict=True)]) & every([x <= y for x, y in zip(hi(s), hi(t), strict=True)])
    overlap = every([G.interval_overlap(*v) for v in zip(lo(a), hi(a), lo(b), hi(b), strict=True)])
    return F.when(inside(a, b) & inside(b, a), "EXACT").when(inside(a, b), "CONTAINED").when(inside(b, a), "CONTAINS").when(overlap, "OVERLAPS")


def bounding_box(points: DataFrame, *by: str, sigma: str | None = None) -> DataFrame:
    """The box of each group's points; with ``sigma``, the largest uncertainty of the points at its lower and upper faces."""
    aggs = [F.min(c).alias(a) for c, a in zip(XYZ, LOW, strict=True)] + [F.max(c).alias(b) for c, b in zip(XYZ, HIGH, strict=True)]
    if sigma:
        aggs += [F.greatest(*[F.min_by(sigma, F.struct(c, -F.col(sigma))) for c in XYZ]).alias("s0"), F.greatest(*[F.max_by(sigma, F.struct(c, sigma)) for c in XYZ]).alias("s1")]
    return points.groupBy(*by).agg(*aggs)


def centroid(points: DataFrame, *by: str) -> DataFrame:
    return points.groupBy(*by).agg(*[F.avg(c).alias(c) for c in XYZ], F.count("*").alias("n"))


def union_boxes(boxes: DataFrame, *by: str) -> DataFrame:
    return boxes.groupBy(*by).agg(*[F.min(c).alias(c) for c in LOW], *[F.max(c).alias(c) for c in HIGH])


def union_points(a: DataFrame, b: DataFrame) -> DataFrame:
    """All different points of both."""
    return a.select(*XYZ).union(b.select(*XYZ)).distinct()


def shared_points(a: DataFrame, b: DataFrame) -> DataFrame:
    """The points of ``a`` that are points of ``b``, all three coordinates equal."""
    return a.join(b.select(*XYZ).distinct(), list(XYZ), "left_semi")


def corners(boxes: DataFrame) -> DataFrame:
    """Eight rows per box with corner (0 to 7) and x, y, z."""
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("corner"), *[F.col((HIGH if i >> k & 1 else LOW)[k]).alias(XYZ[k]) for k in range(3)]) for i in range(8)]))
    return boxes.withColumn("_c", at).select(*boxes.columns, "_c.*")


def transform_points(points: DataFrame, matrix: G.Matrix) -> DataFrame:
    """Points under an affine map; all other columns (uncertainty too) stay."""
    return points.withColumns(dict(zip(XYZ, G.transform(matrix, *map(F.col, XYZ)), strict=True)))


def transform_boxes(boxes: DataFrame, matrix: G.Matrix, id: str) -> DataFrame:
    """The boxes of the eight transformed corners; expressions only, no shuffle."""
    got = [G.transform(matrix, *[F.col((HIGH if i >> k & 1 else LOW)[k]) for k in range(3)]) for i in range(8)]
    return boxes.select(id, *[F.least(*[g[k] for g in got]).alias(LOW[k]) for k in range(3)], *[F.greatest(*[g[k] for g in got]).alias(HIGH[k]) for k in range(3)])


def shift(boxes: DataFrame, v: tuple[float, float, float]) -> DataFrame:
    return boxes.withColumns({c: F.col(c) + v[i] for s in (LOW, HIGH) for i, c in enumerate(s)})


def zoom(boxes: DataFrame, ratio: float) -> DataFrame:
    """Boxes grown by a ratio about their centres."""
    out = {}
    for a, b in zip(LOW, HIGH, strict=True):
        middle, half = (F.col(a) + F.col(b)) / 2, (F.col(b) - F.col(a)) * ratio / 2
        out |= {a: middle - half, b: middle + half}
    return boxes.withColumns(out)


def enclosing_cubes(points: DataFrame, width: float) -> DataFrame:
    return points.withColumns({a: F.col(c) - width / 2 for c, a in zip(XYZ, LOW, strict=True)} | {b: F.col(c) + width / 2 for c, b in zip(XYZ, HIGH, strict=True)})


#: Targets in a leaf of the tree that ``nearest`` goes down.
LEAF = 16
#: So many nodes of a level, or targets in leaves, are sent to all executors; more are joined by a shuffle.
SEND_NODES, SEND_TARGETS = 100_000, 500_000
#: Points of one task of the descent, and levels after which it is written.
DESCENT, LEVELS_AT_ONCE = 20_000, 12


def _tree(targets: DataFrame) -> tuple[list[tuple[DataFrame, int]], DataFrame, int]:
    """Levels of nodes (parent, node, box, a target of it as rx, ry, rz) with their numbers, leaves (node, of) with ``LEAF`` targets at most, and the number of targets.

    Targets (_t, x, y, z) lie at different places.  A node is cut at the middle of
    the box of its own targets, in up to eight, so each cut parts some of them,
    however close they are, and one far away costs a level.
    """
    aggs = [f(c).alias(name) for c, lo, hi in zip(XYZ, LOW, HIGH, strict=True) for f, name in ((F.min, lo), (F.max, hi), (F.first, "r" + c))]
    # first() of three columns is that of one row, as none is null.
    left, parts, levels, whole = targets.withColumns({"parent": F.lit(""), "node": F.lit("")}), [], [], None
    while True:
        nodes = materialise(left.groupBy("parent", "node").agg(F.count("*").alias("n"), *aggs))
        number, rows, large = nodes.agg(F.count("*"), F.sum("n"), F.max("n")).first()
        levels.append((nodes.drop("n"), number))
        whole = rows if whole is None else whole
        octant = F.lit(0)
        for i, (lo, hi) in enumerate(zip(LOW, HIGH, strict=True)):
            middle = F.greatest(F.col(lo), F.col(lo) / 2 + F.col(hi) / 2)
            octant = octant + F.when(F.col(XYZ[i]) > F.when(middle < F.col(hi), middle).otherwise(F.col(lo)), 1 << i).otherwise(0)
        known = nodes.select("node", "n", *LOW, *HIGH)
        cut = left.join(F.broadcast(known) if number <= SEND_NODES else known, "node")
        cut = materialise(cut.select("_t", *XYZ, "node", F.when(F.col("n") > LEAF, F.concat("node", octant.cast("string"))).alias("next")))
        parts.append(cut.filter("next is null").select("node", "_t", *XYZ))
        if not large or large <= LEAF:
            break
        left = cut.filter("next is not null").select("_t", *XYZ, F.col("node").alias("parent"), F.col("next").alias("node"))
    leaves = reduce(DataFrame.union, parts).groupBy("node").agg(F.collect_list(F.struct("_t", *XYZ)).alias("of"))
    return levels, materialise(leaves), whole or 0


def nearest(points: DataFrame, targets: DataFrame, id: str, target_id: str, cell: float | None = None) -> DataFrame:
    """(id, target_id, distance): the nearest target of each point, the smallest id of several.

    Points go down a tree of the targets level by level.  A node's box bounds the
    distance from below, one of its targets from above, and only nodes that may
    hold a nearest target are gone into, so a point looks at a few nodes of each level,
    however many targets there are and however they lie.  A point's nodes
    stay together and in order, so rounds need neither shuffle nor sort while levels are broadcast.

    Points and targets without three finite coordinates are left out.  The result
    doesn't depend on ``cell``, which is kept for callers.
    """
    finite = lambda xyz: [F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) for c in xyz]  # noqa: E731  (NaN is above all numbers)
    whole = lambda df, xyz: df.filter(finite(xyz)[0] & finite(xyz)[1] & finite(xyz)[2])
    place = lambda p: [F.col(c).cast("double").alias(p + c) for c in XYZ]
    left = whole(points, XYZ).select(F.col(id).alias("_p"), *place("p"))
    # Of targets at one place the smallest id stays.
    right = whole(targets, XYZ).select(F.col(target_id).alias("_t"), *place("")).groupBy(*XYZ).agg(F.min("_t").alias("_t"))
    levels, leaves, n = _tree(right)
    p, box = [F.col("p" + c) for c in XYZ], [F.least(F.greatest(F.col("p" + c), F.col(a)), F.col(b)) for c, a, b in zip(XYZ, LOW, HIGH, strict=True)]
    # Both bounds are sums of the same form as the distances, so rounding never puts a nearest target out of them.
    below, above = G.distance(p, box), G.distance(p, [F.col("r" + c) for c in XYZ])
    own = Window.partitionBy("_p")
    deal = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(left.count() / DESCENT))
    state = left.repartition(deal, "_p").withColumns({"at": F.lit(""), "low": F.lit(0.0), "up": F.lit(float("inf"))})
    for k, (nodes, number) in enumerate(levels):
        kids = nodes.withColumnRenamed("parent", "at").withColumnRenamed("node", "kid")
        # A leaf has no nodes below it and waits for the end.
        state = state.join(F.broadcast(kids) if number <= SEND_NODES else kids, "at", "left" if k else "inner")
        state = state.select("_p", *["p" + c for c in XYZ], F.coalesce("kid", "at").alias("at"), F.coalesce(below, "low").alias("low"), F.least("up", above).alias("up")).filter("low <= up")
        state = state.withColumn("up", F.min("up").over(own)).filter("low <= up")
        if (k + 1) % LEVELS_AT_ONCE == 0:
            state = materialise(state)
    leaves = leaves.withColumnRenamed("node", "at")
    met = state.join(F.broadcast(leaves) if n <= SEND_TARGETS else leaves, "at")
    best = F.array_min(F.transform("of", lambda t: F.struct(G.distance(p, [t[c] for c in XYZ]).alias("d"), t["_t"].alias("t"))))
    best = met.select("_p", best.alias("m")).groupBy("_p").agg(F.min("m").alias("m"))
    return materialise(best.select(F.col("_p").alias(id), F.col("m.t").alias(target_id), F.col("m.d").alias("distance")))


def contour_segments(points: DataFrame, cloud: str = "cloud_id", index: str = "idx") -> DataFrame:
    """Ordered points with a segment number that rises where an index is skipped."""
    order = Window.partitionBy(cloud).orderBy(index)
    jump = F.when(F.col(index) - F.lag(index).over(order) > 1, 1).otherwise(0)
    return points.withColumn("_jump", jump).withColumn("segment", F.sum("_jump").over(order)).drop("_jump")


def arc_length(points: DataFrame, cloud: str = "cloud_id", index: str = "idx", dims: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Ordered points with the length of the line up to each."""
    order = Window.partitionBy(cloud).orderBy(index)
    step = G.distance([F.col(c) for c in dims], [F.lag(c).over(order) for c in dims])
    return points.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("length", F.sum("_step").over(order)).drop("_step")


def resample_line(points: DataFrame, n: int, cloud: str = "cloud_id", index: str = "idx", dims: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """``n`` points at equal distances along each line: (cloud, k, dims)."""
    line = arc_length(points, cloud, index, dims)
    order = Window.partitionBy(cloud).orderBy(index)
    whole = F.max("length").over(Window.partitionBy(cloud))
    part = line.withColumns({"_whole": whole, "_end": F.lead("length").over(order)} | {"_" + c: F.lead(c).over(order) for c in dims})
    part = part.filter("_end is not null and _end > length")
    first = F.ceil(F.col("length") * (n - 1) / F.col("_whole") - 1e-9)
    last = F.when(F.col("_end") == F.col("_whole"), F.lit(n - 1).cast("long")).otherwise(F.ceil(F.col("_end") * (n - 1) / F.col("_whole") - 1e-9) - 1)
    part = part.filter(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    t = (F.col("k") * F.col("_whole") / (n - 1) - F.col("length")) / (F.col("_end") - F.col("length"))
    return part.select(cloud, "k", *[(F.col(c) + t * (F.col("_" + c) - F.col(c))).alias(c) for c in dims])
