"""Image patches in planes: their corners, the pixels under them, and the patch search along a cortical surface.

A patch is a row with its corners ``c0`` to ``c3`` (structs x, y, z in mm); c0 and
c1, c2 and c3 are the ends of its two long sides.  Planes are columns nx, ny, nz
(unit normal) and d (distance from the origin).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratlas.functions import geometry as G
from stratlas.operators import locations, voxels as V
from stratlas.session import materialise

XYZ = ("x", "y", "z")
CORNERS = ("c0", "c1", "c2", "c3")
PLANE = ("nx", "ny", "nz", "d")
#: Edge in pixels of the tiles that a patch is dealt out by.
TILE = 64
#: Surfaces (hemispheres) of one search.
MAX_MESHES = 16

Vector = Sequence[Column]


def _dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: Vector, b: Vector) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _unit(a: Vector) -> list[Column]:
    """Null for a vector without length."""
    size = F.nullif(F.sqrt(_dot(a, a)), F.lit(0.0))
    return [c / size for c in a]


def _in(name: str) -> list[Column]:
    """A struct's coordinates."""
    return [F.col(f"{name}.{c}") for c in XYZ]


def _of(name: str) -> list[Column]:
    """A vector kept in three columns.  Intermediate vectors are kept so: structs would be inlined wherever they are used, and their expressions multiply."""
    return [F.col(f"{name}_{c}") for c in XYZ]


def _put(df: DataFrame, **vectors: Vector) -> DataFrame:
    return df.withColumns({f"{name}_{c}": x.cast("double") for name, v in vectors.items() for c, x in zip(XYZ, v, strict=True)})


def _flat(*names: str) -> list[str]:
    return [f"{name}_{c}" for name in names for c in XYZ]


def _vector(a: Vector) -> Column:
    return F.struct(*[x.cast("double").alias(c) for c, x in zip(XYZ, a, strict=True)])


def _minus(a: Vector, b: Vector) -> list[Column]:
    return [p - q for p, q in zip(a, b, strict=True)]


def image_planes(images: DataFrame) -> DataFrame:
    """Flat images (``affine`` row-major, voxels ``sx``, ``sy``, ``sz``) with the plane they lie in, through the middle of their first voxel.

    The axis with the fewest voxels is flat, the first of several; the plane is
    spanned by the other two.  An affine that makes them parallel gives nulls.
    """
    at = lambda k: [F.get("affine", F.lit(4 * r + k)).cast("double") for r in range(3)]
    ways = [_cross(at(i), at(j)) for i, j in ((1, 2), (0, 2), (0, 1))]
    least = F.least("sx", "sy", "sz")
    n = [F.when(F.col("sx") == least, ways[0][r]).when(F.col("sy") == least, ways[1][r]).otherwise(ways[2][r]) for r in range(3)]
    out = _put(_put(images, _n=n), _n=_unit(_of("_n")))
    return out.withColumns(dict(zip(PLANE, (*_of("_n"), _dot(_of("_n"), at(3))), strict=True))).drop(*_flat("_n"))


def flip(patches: DataFrame) -> DataFrame:
    """Patches turned by half a turn: the corners begin at the third one."""
    return patches.withColumns(dict(zip(CORNERS, (F.col(c) for c in ("c2", "c3", "c0", "c1")), strict=True)))


def _signed(a: Vector) -> list[Column]:
    """The vector or its opposite: the first coordinate that isn't zero is positive."""
    sign = F.when(F.abs(a[0]) > 1e-9, F.signum(a[0])).when(F.abs(a[1]) > 1e-9, F.signum(a[1])).otherwise(F.signum(a[2]))
    return [sign * c for c in a]


def enclosing_patches(points: DataFrame, by: Sequence[str], margin: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """A patch for each group of points (``by``, x, y, z and the group's plane): (by, plane, c0 to c3, axis_aligned, points).

    Points are projected to the plane.  The patch runs along their principal axis,
    from the first to the last foot and a margin beyond, and is as wide as the two
    feet are apart that lie outermost across it, with the other margin on either
    side.  Axes show to the positive side of their first coordinate that isn't
    zero; of feet that are equally far out, to 1e-9 mm, the smallest in x, y, z counts.  Patches
    at one y are ``axis_aligned``.  Points without three coordinates are left out;
    one point makes a patch of its margins, along the first axis of the plane.

    Both passes are aggregations by group, with partial sums; in the plane the
    axes come from the three second moments by one arc tangent.
    """
    n = [F.col(c) for c in PLANE[:3]]
    p = _put(points.dropna(subset=[*XYZ, *PLANE]).select(*by, *PLANE, *XYZ), p=G.project(n, F.col("d"), *[F.col(c).cast("double") for c in XYZ])).drop(*XYZ)
    size = [F.abs(c) for c in n]
    first = F.when((size[0] <= size[1]) & (size[0] <= size[2]), F.lit(0)).when(size[1] <= size[2], F.lit(1)).otherwise(F.lit(2))
    p = _put(p.withColumn("_k", first), e1=_cross([(F.col("_k") == k).cast("double") for k in range(3)], n))
    p = _put(_put(p, e1=_unit(_of("e1"))), e2=_cross(n, _of("e1")))
    p = p.withColumns({"s": _dot(_of("p"), _of("e1")), "t": _dot(_of("p"), _of("e2"))})
    moments = p.groupBy(*by).agg(F.var_pop("s").alias("a"), F.covar_pop("s", "t").alias("b"), F.var_pop("t").alias("c"), *[F.first(c).alias(c) for c in _flat("e1", "e2")])
    moments = moments.withColumn("turn", F.atan2(2 * F.col("b"), F.col("a") - F.col("c")) / 2)
    moments = _put(moments, v1=[F.cos("turn") * x + F.sin("turn") * y for x, y in zip(_of("e1"), _of("e2"), strict=True)], v2=[F.cos("turn") * y - F.sin("turn") * x for x, y in zip(_of("e1"), _of("e2"), strict=True)])
    axes = _put(moments, v1=_signed(_of("v1")), v2=_signed(_of("v2"))).select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], *_flat("v1", "v2"))
    same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)]
    far = p.select(*by, *PLANE, *_flat("p")).join(axes, same).withColumns({"a1": _dot(_of("p"), _of("v1")), "a2": _dot(_of("p"), _of("v2"))})
    end = lambda at: F.min(F.struct(F.round(at, 9).alias("at"), _vector(_of("p")).alias("p")))
    ends = far.groupBy(*by).agg(*[F.first(c).alias(c) for c in (*PLANE, *_flat("v1", "v2"))], F.count("*").alias("points"), end(F.col("a1")).alias("q0"), end(-F.col("a1")).alias("q1"), end(F.col("a2")).alias("q2"), end(-F.col("a2")).alias("q3"))
    ends = _put(ends, **{f"p{k}": _in(f"q{k}.p") for k in range(4)})
    m0, m1 = margin
    ends = ends.withColumn("w", G.distance(_of("p3"), _of("p2")) / 2 + m1)
    corner = lambda p, up, out: _vector([q + up * F.col("w") * b + out * m0 * a for q, a, b in zip(_of(p), _of("v1"), _of("v2"), strict=True)])
    got = ends.select(*by, *PLANE, "points", corner("p1", 1, 1).alias("c0"), corner("p0", 1, -1).alias("c1"), corner("p0", -1, -1).alias("c2"), corner("p1", -1, 1).alias("c3"))
    heights = [F.col(f"{c}.y") for c in CORNERS]
    return got.withColumn("axis_aligned", F.greatest(*heights) - F.least(*heights) < 1e-9)


def frames(patches: DataFrame, affine: G.Matrix) -> DataFrame:
    """Patches with the pixel grid that lies along them: centre_, unit steps u_ and v_ (each _x, _y, _z), first pixel (x0, z0) and size (h, w).

    The grid is the image's own, turned about the patch's centre so that its first
    axis runs from c1 to c0 and its third across.  A pixel's width is left out on
    every side; patches that are too small for that have a size of 0 or less, and
    those without area or corners none.  The affine is one of scale and shift.
    """
    if any(affine[i][j] for i in range(3) for j in range(3) if i != j) or not all(affine[i][i] > 0 for i in range(3)):
        raise ValueError("patches are taken from images whose axes are those of the space")
    scale, shift = [affine[i][i] for i in range(3)], [affine[i][3] for i in range(3)]
    p = _put(patches, **{f"_{k}": _in(k) for k in CORNERS})
    p = _put(p, centre=[sum((F.col(f"_{k}_{c}") for k in CORNERS), F.lit(0.0)) / 4 for c in XYZ], u=_minus(_of("_c0"), _of("_c1")))
    p = _put(p, u=_unit(_of("u")))
    p = _put(p, _n=_cross(_of("u"), _minus(_of("_c3"), _of("_c0"))))
    n = _of("_n")
    big = F.greatest(*[F.abs(c) for c in n])
    sign = F.when(F.abs(n[0]) == big, F.signum(n[0])).when(F.abs(n[1]) == big, F.signum(n[1])).otherwise(F.signum(n[2]))
    p = _put(p, _n=[sign * c for c in _unit(n)])
    p = _put(p, v=_cross(_of("u"), _of("_n")))
    for name, axis, step, size in (("x", 0, "u", "h"), ("z", 2, "v", "w")):
        begin = F.floor((F.least(*[F.col(f"_{k}_{name}") for k in CORNERS]) - shift[axis]) / scale[axis])
        p = p.withColumn("_b", begin)
        p = p.withColumns({f"_t{j}": ((F.col(f"centre_{name}") + _dot(_of(step), _minus(_of(f"_{k}"), _of("centre"))) - shift[axis]) / scale[axis] - F.col("_b")).cast("int") for j, k in enumerate(CORNERS)})
        at = [f"_t{j}" for j in range(4)]
        p = p.withColumns({f"{name}0": F.col("_b") + F.least(*at) + 1, size: F.greatest(*at) - F.least(*at) - 2}).drop("_b", *at)
    return p.drop(*_flat("_n", *[f"_{k}" for k in CORNERS]))


def _places(affine: G.Matrix, i: Column, k: Column, flat: int | None) -> list[Column]:
    """Voxel coordinates of a pixel of a frame; along a flat axis those of the image's voxel."""
    dx = affine[0][0] * (F.col("x0") + i) + affine[0][3] - F.col("centre_x")
    dz = affine[2][2] * (F.col("z0") + k) + affine[2][3] - F.col("centre_z")
    q = [(F.col(f"centre_{c}") + F.col(f"u_{c}") * dx + F.col(f"v_{c}") * dz - affine[r][3]) / affine[r][r] for r, c in enumerate(XYZ)]
    return [F.round(c) if r == flat else c for r, c in enumerate(q)]


def extract(patches: DataFrame, voxels: DataFrame, affine: G.Matrix, id: str, flat: int | None = None, on: Sequence[str] = (), size: int = V.BLOCK) -> DataFrame:
    """The image under each patch, in whatever direction it lies: (id, i, k, value), nonzero pixels.

    A pixel's value is that of the eight voxels around its place, weighted linearly;
    voxels that the image doesn't have count 0.  ``flat`` names the axis along
    which an image is one voxel thick, ``on`` columns that patch and voxels share
    (their image).  i runs from c1 to c0, k across.  Of several patches with one id
    and image one is taken, that with the largest frame.

    Large patches are dealt out in tiles of 64 pixels a side.  The blocks that tiles
    cross are known before any pixel is, and other blocks of the volume are not
    joined; a volume stored by blocks isn't even read there.
    """
    parts = [*_flat("centre", "u", "v"), "x0", "z0", "h", "w"]
    # One row an id; the conditions on the size stay behind this aggregation, where they are columns and not long expressions.
    f = frames(patches.select(id, *on, *CORNERS), affine).groupBy(id, *on).agg(F.max(F.struct(*parts)).alias("f")).select(id, *on, "f.*").filter("h > 0 and w > 0")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / TILE).cast("int")))
    tiles = f.withColumn("ti", span("h")).withColumn("tk", span("w"))
    tiles = tiles.select(id, *on, *parts[:-2], *[(F.col(t) * TILE).cast("int").alias(a) for t, a in (("ti", "i0"), ("tk", "k0"))], F.least(F.col("h"), (F.col("ti") + 1) * TILE).cast("int").alias("i1"), F.least(F.col("w"), (F.col("tk") + 1) * TILE).cast("int").alias("k1"))
    tiles = tiles.repartition(id, "i0", "k0")
    ends = [_places(affine, F.col(i), F.col(k), flat) for i in ("i0", "i1") for k in ("k0", "k1")]
    crossed = tiles.withColumns({f"l{c}": F.floor(F.floor(F.least(*[e[r] for e in ends])) / size).cast("int") for r, c in enumerate(XYZ)} | {f"h{c}": F.floor((F.floor(F.greatest(*[e[r] for e in ends])) + 1) / size).cast("int") for r, c in enumerate(XYZ)})
    for c in XYZ:
        crossed = crossed.withColumn("b" + c, F.explode(F.sequence("l" + c, "h" + c)))
    # The filter tells the optimizer that blocks are few, so it prunes partitions by them.
    crossed = crossed.filter("i0 >= 0").select(*on, *["b" + c for c in XYZ]).distinct()
    stored = voxels if all("b" + c in voxels.columns for c in XYZ) else V.with_blocks(voxels, size)
    under = stored.filter("value <> 0").join(crossed, [*on, *["b" + c for c in XYZ]], "left_semi").select(*on, *XYZ, "value")

    pixels = tiles.withColumn("i", F.explode(F.sequence("i0", F.col("i1") - 1))).withColumn("k", F.explode(F.sequence("k0", F.col("k1") - 1)))
    q = _places(affine, F.col("i"), F.col("k"), flat)
    pixels = pixels.select(id, *on, "i", "k", *[x.alias("q" + c) for c, x in zip(XYZ, q, strict=True)])
    pixels = pixels.withColumn("o", F.explode(F.array(*map(F.lit, range(8)))))
    far = {c: F.col("o").bitwiseAND(1 << r) > 0 for r, c in enumerate(XYZ)}
    part = {c: F.col("q" + c) - F.floor("q" + c) for c in XYZ}
    weight = F.lit(1.0)
    for c in XYZ:
        weight = weight * F.when(far[c], part[c]).otherwise(1 - part[c])
    corners = pixels.select(id, *on, "i", "k", *[(F.floor("q" + c) + far[c].cast("int")).cast("int").alias(c) for c in XYZ], weight.alias("w")).filter("w > 0")
    met = corners.join(under, [*on, *XYZ])
    return met.groupBy(id, *on, "i", "k").agg(F.sum(F.col("w") * F.col("value")).alias("value")).filter("value <> 0")


def mesh_crossings(verts: DataFrame, faces: DataFrame, sections: DataFrame, cell: float = 1.0) -> DataFrame:
    """Where edges of meshes cross sections at one y (``section`` and its plane): (section, plane, mesh, edge, x, y, z).

    Edges and sections meet by cells along y.  An edge is named by its two
    vertices; a place that several edges share keeps the smallest name.  A closed
    mesh has every point of its contours once.  Sections that don't lie across y,
    and edges without coordinates, are left out.
    """
    ends = F.array(*[F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v0", "v2"))])
    edges = faces.select("mesh", F.explode(ends).alias("e")).select("mesh", "e.a", "e.b").distinct()
    at = verts.dropna(subset=list(XYZ)).select("mesh", "vid", _vector([F.col(c) for c in XYZ]).alias("p"))
    edges = edges.join(at.select("mesh", F.col("vid").alias("a"), F.col("p").alias("p")), ["mesh", "a"]).join(at.select("mesh", F.col("vid").alias("b"), F.col("p").alias("q")), ["mesh", "b"])
    low, high = F.least("p.y", "q.y"), F.greatest("p.y", "q.y")
    edges = edges.withColumn("cell", F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell))))
    planes = sections.filter("abs(ny) > 1 - 1e-12").select("section", *PLANE, (F.col("d") * F.col("ny")).alias("_y")).withColumn("cell", F.floor(F.col("_y") / cell))
    side = lambda p: F.col(f"{p}.y") * F.col("ny") >= F.col("d")
    hit = edges.join(planes, "cell").filter(side("p") != side("q"))
    t = (F.col("_y") - F.col("p.y")) / F.nullif(F.col("q.y") - F.col("p.y"), F.lit(0.0))
    places = [F.col(f"p.{c}") + t * (F.col(f"q.{c}") - F.col(f"p.{c}")) for c in XYZ]
    hit = hit.select("section", *PLANE, "mesh", F.struct("a", "b").alias("edge"), places[0].alias("x"), F.col("_y").alias("y"), places[2].alias("z"))
    return hit.groupBy("section", *PLANE, "mesh", *XYZ).agg(F.min("edge").alias("edge")).select("section", *PLANE, "mesh", "edge", *XYZ)


def surface_patches(sections: DataFrame, layers: DataFrame, faces: DataFrame, middle: str, volume: DataFrame, affine: G.Matrix, lower_threshold: float = 0.0, margin: tuple[float, float] = (0.5, 0.5), cell: float = 1.0) -> DataFrame:
    """Patches across a surface where flat sections cut it, weighted by an image, the most relevant first.

    ``sections`` are flat images (section, affine, sx, sy, sz) with their boxes (x0 to
    z1); ``layers`` vertices (mesh, layer, vid, x, y, z) of surfaces that share their
    vertices' numbers, ``faces`` the middle one's (mesh, v0, v1, v2); ``volume``
    nonzero voxels of one image and ``affine`` its place.  Rows are (section, mesh,
    vid, relevance, x, y, z, profile, c0 to c3).

    Sections that hold a voxel (half a voxel of tolerance) at or over the threshold
    are cut with the middle surfaces whose box meets the image's.  Where an edge
    crosses, the image's value (voxel truncated) is the relevance, and places below
    the threshold go; with threshold 0 all places stay, those of value 0 too.  Each
    takes the nearest vertex of its surface; that vertex in all layers is its
    profile, and the profile's patch in the section is the result.  Sections that
    don't lie across y give none.
    """
    kept = volume.filter((F.col("value") != 0) & (F.col("value") >= lower_threshold)).select(*XYZ, "value")
    mm = dict(zip(XYZ, G.transform(affine, *[F.col(c).cast("double") for c in XYZ]), strict=True))
    half = [sum(abs(affine[r][j]) for j in range(3)) / 2 for r in range(3)]
    wide = sections.select("section", *[(F.col(c + "0") - h).alias(c + "0") for c, h in zip(XYZ, half, strict=True)], *[(F.col(c + "1") + h).alias(c + "1") for c, h in zip(XYZ, half, strict=True)])
    hit = locations.points_in_boxes(kept.select(*[mm[c].alias(c) for c in XYZ]), wide.withColumnRenamed("section", "box")).select(F.col("box").alias("section")).distinct()
    planes = image_planes(sections.join(hit, "section", "left_semi")).select("section", *PLANE)

    around = kept.select(*[mm[c].alias(c) for c in XYZ]).agg(*[f(c).alias(f"_{c}{i}") for c in XYZ for i, f in ((0, F.min), (1, F.max))])
    center = layers.filter(F.col("layer") == middle)
    bounds = center.groupBy("mesh").agg(*[f(c).alias(c + str(i)) for c in XYZ for i, f in ((0, F.min), (1, F.max))])
    meet = [(F.col(c + "0") <= F.col(f"_{c}1") + h) & (F.col(c + "1") >= F.col(f"_{c}0") - h) for c, h in zip(XYZ, half, strict=True)]
    names = [r.mesh for r in bounds.join(F.broadcast(around), meet[0] & meet[1] & meet[2]).select("mesh").limit(MAX_MESHES + 1).collect()]
    if len(names) > MAX_MESHES:
        raise ValueError(f"more than {MAX_MESHES} surfaces in one search")

    crossings = mesh_crossings(center.filter(F.col("mesh").isin(names)), faces.filter(F.col("mesh").isin(names)), planes, cell)
    to_voxel = G.inverse(affine)
    scored = V.evaluate(V.voxel_of(crossings, to_voxel, half=False), kept).filter(F.col("value") >= lower_threshold).drop("vx", "vy", "vz")
    scored = materialise(scored.withColumn("point", F.struct("section", "mesh", "edge")))
    found = None
    for name in names:
        at = locations.nearest(scored.filter(F.col("mesh") == name), center.filter(F.col("mesh") == name), "point", "vid", cell).select("point", "vid")
        found = at if found is None else found.union(at)
    if found is None:
        found = scored.select("point", F.lit(None).cast(layers.schema["vid"].dataType).alias("vid")).limit(0)
    placed = scored.join(found, "point")
    spots = layers.select("mesh", "vid", F.col("layer"), _vector([F.col(c) for c in XYZ]).alias("at"))
    profile = placed.select("point", "mesh", "vid", *PLANE).join(spots, ["mesh", "vid"])
    patch = enclosing_patches(profile.select("point", *PLANE, "at.*"), ["point"], margin).filter("axis_aligned")
    lines = spots.groupBy("mesh", "vid").agg(F.array_sort(F.collect_list(F.struct("layer", "at"))).alias("profile"))
    got = placed.join(patch.select("point", *CORNERS), "point").join(lines, ["mesh", "vid"])
    return got.select("section", "mesh", "vid", F.col("value").alias("relevance"), *XYZ, "profile", *CORNERS).orderBy(F.desc("relevance"), "section", "mesh", *XYZ)
