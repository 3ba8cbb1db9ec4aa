"""Measurements per region: connectivity, time series, profiles, densities, spectra, expressions.

All are aggregations or windows over long tables; a matrix is rows (src, dst,
value), a profile rows (depth, value), a recording rows (t, region, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Thickness of a section (micrometres) and the cube root of the volume's shrinkage: fixed values.
SECTION_UM, SHRINKAGE = 20.0, 1.931


def mean_std(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean and population deviation of the elements of a compound, by key."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def profile(conn: DataFrame, region: str, minimum: float = 0.0, rows: int | None = None, column: bool = True) -> DataFrame:
    """Regions connected to one more strongly than ``minimum``, strongest first; of columns, or of rows."""
    own, other = ("dst", "src") if column else ("src", "dst")
    out = conn.filter((F.col(own) == region) & (F.col("value") > minimum)).select(F.col(other).alias("region"), "value").orderBy(F.desc("value"), "region")
    return out.limit(rows) if rows else out


def relative(rows: DataFrame, value: str = "value") -> DataFrame:
    """Values divided by the largest one, for a colour scale."""
    top = rows.agg(F.max(value).alias("_top"))
    return rows.join(F.broadcast(top), F.lit(True)).withColumn("relative", F.col(value) / F.col("_top")).drop("_top")


def label_positions(rows: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    """Positions in matrix or table columns replaced by the region names at these positions (pos, region)."""
    for c in columns:
        rows = rows.join(labels.select(F.col("pos").alias(c), F.col("region").alias("_" + c)), c).drop(c).withColumnRenamed("_" + c, c)
    return rows


def region_centroids(labels: DataFrame, centroids: DataFrame) -> DataFrame:
    """The mean place of each label's regions."""
    return labels.join(centroids, "region").groupBy("pos").agg(*[F.avg(c).alias(c) for c in "xyz"])


def unique_labels(rows: DataFrame, label: str, order: str, *by: str) -> DataFrame:
    """Labels made unique by as many asterisks as the label stood before."""
    n = F.row_number().over(Window.partitionBy(*by, label).orderBy(order))
    return rows.withColumn("unique_label", F.concat(F.col(label), F.repeat(F.lit("*"), n - 1)))


def time_axis(rows: DataFrame, step: float, order: str, *by: str) -> DataFrame:
    return rows.withColumn("t", (F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1) * F.lit(step))


def layer_depths(rows: DataFrame, thickness: str, layer: str, *by: str) -> DataFrame:
    """Relative depth at which each layer ends; columns without thickness are dropped, and the last layer ends at 1."""
    part = Window.partitionBy(*by)
    upto = part.orderBy(layer).rowsBetween(Window.unboundedPreceding, 0)
    x = rows.withColumns({"_all": F.sum(thickness).over(part), "_sum": F.sum(thickness).over(upto), "_last": F.max(layer).over(part)}).filter("_all > 0")
    return x.withColumn("depth", F.when(F.col(layer) == F.col("_last"), 1.0).otherwise(F.col("_sum") / F.col("_all"))).drop("_all", "_sum", "_last")


def assign_layer(rows: DataFrame, boundaries: DataFrame, depth: str = "depth") -> DataFrame:
    """Rows with the layer their depth is in: the last whose upper boundary (layer, top) is above; null at depth 0.

    The boundaries are the seven of a cortical profile, so they are one array.
    """
    tops = boundaries.agg(F.sort_array(F.collect_list(F.struct("top", "layer"))).alias("_tops"))
    inside = F.filter("_tops", lambda b: b["top"] < F.col(depth))
    return rows.join(F.broadcast(tops), F.lit(True)).withColumn("layer", F.element_at(F.when(F.size(inside) > 0, inside), -1)["layer"]).drop("_tops")


def layer_statistics(rows: DataFrame, boundaries: DataFrame, value: str = "value", *by: str) -> DataFrame:
    return mean_std(assign_layer(rows, boundaries).filter("layer between 1 and 6"), [*by, "layer"], value)


def layer_densities(cells: DataFrame, layers: DataFrame, *by: str) -> DataFrame:
    """Cells per layer over the layer's volume (0.1 mm cubed); layers without an area are left out."""
    counts = cells.groupBy(*by, "layer").agg(F.count("*").alias("counts"))
    volume = F.col("area") * SECTION_UM * F.cbrt(F.lit(SHRINKAGE)) / 100**3
    return counts.join(layers, [*by, "layer"]).withColumn("volume", volume).withColumn("density", F.col("counts") / F.col("volume"))


def grid_counts(points: DataFrame, width: float = 100.0, *by: str) -> DataFrame:
    return points.groupBy(*by, F.floor(F.col("x") / width).alias("gx"), F.floor(F.col("y") / width).alias("gy")).agg(F.count("*").alias("n"))


def depth_profile(rows: DataFrame, bins: int = 100, depth: str = "depth", value: str = "value", *by: str) -> DataFrame:
    """Mean value in each of ``bins`` equal depth bins (0 to 1); bins without rows have none."""
    at = F.least(F.floor(F.col(depth) * bins), F.lit(bins - 1))
    return rows.filter(F.col(depth).between(0, 1)).groupBy(*by, at.alias("bin")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def mean_depth(boundary: DataFrame, depths: DataFrame) -> DataFrame:
    """Mean depth along each boundary: its pixels joined to the depth image."""
    return boundary.join(depths, ["x", "y"]).groupBy("boundary").agg(F.avg("depth").alias("depth"))


def decibel(power: Column) -> Column:
    """10 log10 of a power: minus infinity for 0, null below."""
    return F.when(power > 0, 10 * F.log10(power)).when(power == 0, float("-inf"))


def spectrum(rows: DataFrame, value: Column, *by: str) -> DataFrame:
    """Median over time per file and frequency, then the mean over files; nulls and NaN are no values."""
    clean = F.when(~F.isnan(value), value)
    per_file = rows.withColumn("_v", clean).groupBy(*by, "file", "freq").agg(F.median("_v").alias("m"))
    return per_file.groupBy(*by, "freq").agg(F.avg("m").alias("power"), F.count("m").alias("files"))


def grouped_recordings(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Recordings by all their keys; a null key is in no group."""
    return rows.na.drop(subset=keys).groupBy(*keys).agg(F.count("*").alias("recordings"))


def options(rows: DataFrame, *columns: str) -> DataFrame:
    """The values each filter column can take."""
    return rows.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in columns])


def filter_recordings(rows: DataFrame, **wanted) -> DataFrame:
    """Rows that have the wanted value in each column for which one is given."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.filter(F.col(column).isin(value) if isinstance(value, (list, tuple)) else F.col(column) == value)
    return rows


def fingerprint_value(x: Column) -> Column:
    """A number, or 0 for anything else."""
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def neurotransmitters(rows: DataFrame, vocabulary: DataFrame, receptor: str = "receptor") -> DataFrame:
    """Receptors with their transmitter's name, '(undeciphered)' where the vocabulary has none."""
    v = vocabulary.select(F.col("symbol").alias(receptor), F.col("transmitter").alias("_t"))
    return rows.join(v, receptor, "left").withColumn("neurotransmitter", F.coalesce("_t", F.lit("(undeciphered)"))).drop("_t")


def expressions(probes: DataFrame, samples: DataFrame, donors: DataFrame) -> DataFrame:
    """Probes hold an array of levels and of z-scores over the donor's samples: one row for each, with the sample's place in template space, rounded to hundredths half to even, and the donor's factors."""
    levels = probes.select("probe_id", "gene", "donor_id", F.posexplode(F.arrays_zip("level", "zscore")).alias("sample", "v"))
    placed = levels.join(samples, ["donor_id", "sample"]).join(donors, "donor_id")
    m = F.col("affine")
    at = [F.bround(F.get(m, F.lit(4 * r)) * F.col("x") + F.get(m, F.lit(4 * r + 1)) * F.col("y") + F.get(m, F.lit(4 * r + 2)) * F.col("z") + F.get(m, F.lit(4 * r + 3)), 2) for r in range(3)]
    return placed.select(F.col("v.level").alias("level"), F.col("v.zscore").alias("zscore"), "gene", "race", "gender", (F.col("age_days") / 365).cast("int").alias("age"), F.array(*at).alias("place"), "sample", "probe_id", "donor_id")


def faulty_profiles(profiles: DataFrame, boundaries: DataFrame, by: str = "feature_id") -> DataFrame:
    """Profiles that break a rule: depths in 0 to 1 and different, boundaries rising in 0 to 1, seven or none of them."""
    p = profiles.groupBy(by).agg(F.bool_or(~F.col("depth").between(0, 1)).alias("outside"), (F.count("*") > F.count_distinct("depth")).alias("twice"))
    order = Window.partitionBy(by).orderBy("layer")
    b = boundaries.withColumn("_fall", F.col("depth") < F.lag("depth").over(order)).groupBy(by).agg(F.bool_or("_fall").alias("falling"), F.bool_or(~F.col("depth").between(0, 1)).alias("beyond"), (F.count("*") != 7).alias("count"))
    x = p.join(b, by, "full_outer").fillna(False)
    return x.filter("outside or twice or falling or beyond or count")
