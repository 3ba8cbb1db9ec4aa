"""Polygons on pixel grids: vertices as rows (polygon, ring, k, x, y), k from 0 without gaps; rasters as rows (polygon, x, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How near to an edge a pixel is on it.
NEAR = 1e-9
LAYERS = range(1, 8)


def edges(vertices: DataFrame) -> DataFrame:
    """(polygon, ring, x, y, x2, y2), each vertex to the next and the last to the first."""
    v = vertices.dropna(subset=["polygon", "ring", "k", "x", "y"]).select("polygon", "ring", "k", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    count = v.groupBy("polygon", "ring").agg(F.count("*").alias("n"))
    after = v.join(count, ["polygon", "ring"]).select("polygon", "ring", F.pmod(F.col("k") - 1, F.col("n")).alias("k"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return v.withColumn("k", F.col("k").cast("long")).join(after, ["polygon", "ring", "k"]).drop("k")


def raster(vertices: DataFrame) -> DataFrame:
    """The pixels (polygon, x, y: whole numbers) in each polygon or on its edges.

    Edges are dealt out to the rows that they cross; the crossings of a row in order
    are the ends of its spans, inside by the even-odd rule over all rings, so a ring
    in another is a hole (its own edges belong to the polygon).  An edge counts from
    its lower end to below its upper one, so a vertex on a row is crossed once where
    a line goes through and twice or never where it turns; level edges and vertices
    on pixels are added.  Vertices without coordinates break a ring and are an error
    of the input: the edges to them are missing.
    """
    e = edges(vertices)
    low, high = F.least("y", "y2"), F.greatest("y", "y2")
    rows = e.filter("y <> y2").withColumns({"first": F.ceil(low).cast("int"), "last": (F.ceil(high) - 1).cast("int")})
    rows = rows.withColumn("row", F.explode(F.when(F.col("first") <= F.col("last"), F.sequence("first", "last"))))
    at = rows.select("polygon", "row", (F.col("x") + (F.col("row") - F.col("y")) / F.nullif(F.col("y2") - F.col("y"), F.lit(0.0)) * (F.col("x2") - F.col("x"))).alias("at"))
    order = Window.partitionBy("polygon", "row").orderBy("at")
    spans = at.withColumns({"j": F.row_number().over(order), "end": F.lead("at").over(order)}).filter("j % 2 = 1").select("polygon", "row", F.col("at").alias("begin"), "end")
    level = e.filter("y = y2 and y = floor(y)").select("polygon", F.col("y").cast("int").alias("row"), F.least("x", "x2").alias("begin"), F.greatest("x", "x2").alias("end"))
    corners = e.filter("y = floor(y)").select("polygon", F.col("y").cast("int").alias("row"), F.col("x").alias("begin"), F.col("x").alias("end"))
    every = spans.union(level).union(corners).withColumns({"a": F.ceil(F.col("begin") - NEAR).cast("int"), "b": F.floor(F.col("end") + NEAR).cast("int")})
    return every.withColumn("p", F.explode(F.when(F.col("a") <= F.col("b"), F.sequence("a", "b")))).select("polygon", F.col("p").alias("x"), F.col("row").alias("y")).distinct()


def layer_polygons(boundaries: DataFrame, shapes: DataFrame) -> DataFrame:
    """Polygons of cortical layers 1 to 7 from the lines between them: vertices with (image, layer) as ``polygon``.

    ``boundaries`` (image, boundary, x, y): boundary b, 0 to 6, lies between layers b and
    b + 1; ``shapes`` (image, sx, sy).  A line runs from left to right, starts at the
    left edge and is trimmed to the image; the last layer ends at the image's end.  A
    layer is its upper line and its lower one backwards; one that lacks a line is left out.
    """
    by = ["image", "boundary"]
    line = boundaries.dropna(subset=[*by, "x", "y"]).join(shapes, "image")
    k = F.row_number().over(Window.partitionBy(*by).orderBy("x", "y")) - 1
    line = line.withColumn("k", k).withColumn("x", F.when(F.col("k") == 0, 0.0).otherwise(F.least("x", "sx").cast("double"))).withColumn("y", F.least("y", "sy").cast("double")).select(*by, "k", "x", "y")
    end = shapes.select("image", F.lit(max(LAYERS)).alias("boundary"), F.explode(F.array(*[F.struct(F.lit(i).alias("k"), x.cast("double").alias("x"), F.col("sy").cast("double").alias("y")) for i, x in enumerate((F.lit(0.0), F.col("sx")))])).alias("v")).select("image", "boundary", "v.*")
    line = line.filter(F.col("boundary").between(0, max(LAYERS) - 1)).select("image", F.col("boundary").cast("int").alias("boundary"), "k", "x", "y").union(end)
    counts = line.groupBy(*by).agg(F.count("*").alias("n"))
    upper = line.select("image", (F.col("boundary") + 1).alias("layer"), F.col("k").cast("long").alias("k"), "x", "y").filter(F.col("layer") <= max(LAYERS))
    lower = line.join(counts, by).select("image", F.col("boundary").alias("layer"), (F.col("n") - 1 - F.col("k")).alias("k"), "x", "y")
    above = counts.select("image", (F.col("boundary") + 1).alias("layer"), "n")
    lower = lower.join(above, ["image", "layer"]).select("image", "layer", (F.col("k") + F.col("n")).alias("k"), "x", "y")
    upper = upper.join(counts.select("image", F.col("boundary").alias("layer")), ["image", "layer"], "left_semi")
    return upper.union(lower).select(F.struct("image", "layer").alias("polygon"), F.lit(0).alias("ring"), "k", "x", "y")


def layer_mask(boundaries: DataFrame, shapes: DataFrame) -> DataFrame:
    """(image, x, y, layer): the layer of each pixel of 0 to the image's size, the lower one where two meet."""
    got = raster(layer_polygons(boundaries, shapes)).select("polygon.image", "x", "y", "polygon.layer")
    got = got.join(shapes, "image").filter("x between 0 and sx and y between 0 and sy")
    return got.groupBy("image", "x", "y").agg(F.max("layer").alias("layer"))
