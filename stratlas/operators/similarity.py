"""How alike two images are: overlap, containedness, correlation, weighted means, mutual information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def paired(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """Voxels of either image with both values (a, b), 0 where there is none."""
    left = a.filter("value > 0").select(*by, *XYZ, F.col("value").alias("a"))
    right = b.filter("value > 0").select(*by, *XYZ, F.col("value").alias("b"))
    return left.join(right, [*by, *XYZ], "full_outer").fillna(0.0, ["a", "b"])


def _sums(a: str = "a", b: str = "b") -> list[Column]:
    x, y = F.col(a), F.col(b)
    return [
        F.count_if((x > 0) & (y > 0)).alias("n_both"),
        F.count_if(x > 0).alias("n_a"),
        F.count_if(y > 0).alias("n_b"),
        F.count("*").alias("n_any"),
        F.sum(x).alias("sum_a"),
        F.sum(y).alias("sum_b"),
        F.sum(x * y).alias("sum_ab"),
        F.sum(x * x).alias("sum_aa"),
        F.sum(y * y).alias("sum_bb"),
    ]


def compare(pairs: DataFrame, *by: str, size: int | Column | None = None, dense: bool = False) -> DataFrame:
    """Scores of paired images in one aggregation.

    ``size`` is the number of voxels that the means are taken over (the image, or
    the box of both); zeros need no rows.  ``dense`` sums the products of
    deviations over the union only, although the means are over the image;
    otherwise it is the plain correlation over all ``size`` voxels.
    """
    s = pairs.groupBy(*by).agg(*_sums())
    n = F.col("n_any").cast("double") if size is None else (F.lit(size) if isinstance(size, int) else size).cast("double")
    over = F.col("n_any").cast("double") if dense else n
    ma, mb = F.col("sum_a") / n, F.col("sum_b") / n
    cov = F.col("sum_ab") - mb * F.col("sum_a") - ma * F.col("sum_b") + over * ma * mb
    va = F.col("sum_aa") - 2 * ma * F.col("sum_a") + over * ma * ma
    vb = F.col("sum_bb") - 2 * mb * F.col("sum_b") + over * mb * mb
    root = F.sqrt(F.greatest(va * vb, F.lit(0.0)))
    part = lambda p, q: F.when(q > 0, p / q).otherwise(F.lit(0.0))
    return s.select(
        *by,
        part(F.col("n_both"), F.col("n_any")).alias("iou"),
        part(F.col("n_both"), F.col("n_b")).alias("b_contained"),
        part(F.col("n_both"), F.col("n_a")).alias("a_contained"),
        part(cov, root).alias("correlation"),
        part(F.col("sum_ab"), F.col("sum_b")).alias("weighted_mean_of_a"),
        part(F.col("sum_ab"), F.col("sum_a")).alias("weighted_mean_of_b"),
        "n_both",
    )


def compare_across(maps: DataFrame, queries: DataFrame, map_by: str, query_by: str, own: DataFrame | None = None) -> DataFrame:
    """Scores of every map region with every query component that share a voxel, never their product.

    Sums over one image alone come from one aggregation each; sums over both need
    only the voxels they share.  The size is the box of both images, whose upper
    ends count one beyond the last voxel for the query and none for the map.
    ``own`` has the queries' sums where they are known (q, n_b, s_b, ss_b, max_b and
    the box's ends b_x0, b_x1, ...); ``queries`` then need no voxels outside the maps.
    """
    m = maps.filter("value > 0").select(F.col(map_by).alias("m"), *XYZ, F.col("value").alias("a"))
    q = queries.filter("value > 0").select(F.col(query_by).alias("q"), *XYZ, F.col("value").alias("b"))

    def alone(df: DataFrame, key: str, v: str) -> DataFrame:
        return df.groupBy(key).agg(
            F.count("*").alias("n_" + v), F.sum(v).alias("s_" + v), F.sum(F.col(v) * F.col(v)).alias("ss_" + v), F.max(v).alias("max_" + v), *[F.min(c).alias(f"{v}_{c}0") for c in XYZ], *[F.max(c).alias(f"{v}_{c}1") for c in XYZ]
        )

    both = m.join(q, list(XYZ)).groupBy("m", "q").agg(F.count("*").alias("n_both"), F.sum(F.col("a") * F.col("b")).alias("s_ab"))
    x = both.join(alone(m, "m", "a"), "m").join(alone(q, "q", "b") if own is None else own, "q")
    n = F.lit(1.0)
    for c in XYZ:
        n = n * (F.greatest(F.col(f"a_{c}1"), F.col(f"b_{c}1") + 1) - F.least(F.col(f"a_{c}0"), F.col(f"b_{c}0")))
    va = F.col("ss_a") - F.col("s_a") * F.col("s_a") / n
    vb = F.col("ss_b") - F.col("s_b") * F.col("s_b") / n
    root = F.sqrt(F.greatest(va * vb, F.lit(0.0)))
    return x.select(
        F.col("m").alias(map_by),
        F.col("q").alias(query_by),
        (F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both"))).alias("iou"),
        (F.col("n_both") / F.col("n_b")).alias("input_contained"),
        (F.col("n_both") / F.col("n_a")).alias("map_contained"),
        F.when(root > 0, (F.col("s_ab") - F.col("s_a") * F.col("s_b") / n) / root).otherwise(0.0).alias("correlation"),
        (F.col("s_ab") / F.col("s_b")).alias("map_weighted_mean"),
        (F.col("s_ab") / F.col("s_a")).alias("input_weighted_mean"),
        F.col("max_a").alias("map_value"),
    )


def mutual_information(pairs: DataFrame, bins: int = 100, normalised: bool = False, a: str = "a", b: str = "b") -> DataFrame:
    """One row with the mutual information (nats) of two columns, each cut into equal bins between its extremes."""
    ends = pairs.agg(F.min(a).alias("a0"), F.max(a).alias("a1"), F.min(b).alias("b0"), F.max(b).alias("b1"))
    bin_of = lambda v, lo, hi: F.when(F.col(hi) > F.col(lo), F.least(F.floor((F.col(v) - F.col(lo)) * bins / (F.col(hi) - F.col(lo))), F.lit(bins - 1))).otherwise(F.lit(0))
    joint = pairs.join(F.broadcast(ends), F.lit(True)).groupBy(bin_of(a, "a0", "a1").alias("i"), bin_of(b, "b0", "b1").alias("j")).agg(F.count("*").alias("n"))
    rows, columns = joint.groupBy("i").agg(F.sum("n").alias("ni")), joint.groupBy("j").agg(F.sum("n").alias("nj"))
    total = joint.agg(F.sum("n").alias("t"))
    entropy = lambda df, n: df.join(F.broadcast(total), F.lit(True)).agg((-F.sum(F.col(n) / F.col("t") * F.ln(F.col(n) / F.col("t")))).alias("h" + n))
    mi = joint.join(rows, "i").join(columns, "j").join(F.broadcast(total), F.lit(True)).agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("ni") * F.col("nj")))).alias("mi"))
    if not normalised:
        return mi
    both = mi.join(entropy(rows, "ni"), F.lit(True)).join(entropy(columns, "nj"), F.lit(True))
    return both.select((2 * F.col("mi") / (F.col("hni") + F.col("hnj"))).alias("mi"))
