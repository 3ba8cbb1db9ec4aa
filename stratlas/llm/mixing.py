"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight that changes linearly over the run.  The integral of
its weight is its cumulative token demand; a document's place in its source's
order is a cumulative supply, and inverting the demand at that place gives the
document's training position.  Sorting all copies by position by ranges is the
mixed corpus.

Places are prefix sums by source in hash order.  They are computed in two steps,
sums of 4096 hash ranges per source and then running sums within a range, so a
source with a third of all rows is 4096 groups.  The global order is a range sort
by position: partitions are numbered from within, and a running sum of their
counts (one row a partition) makes the numbers global.  The table of sources,
one row each, passes through windows without a partition.

Defined cases: a null text has size 0; null is a source of its own, the last; a
source without words has target 0; rows that repeat take their copies one by
one; an empty table gives an empty mix; other columns are carried and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratlas.llm.textops import cut, fresh

MOST = 3
_TRIM = " \t\n\u000b\f\r"
#: Weight at the start and at the end of the run, by the source's nominal weight: light sources early, heavy ones late.
RAMPS = {1: (1.5, 0.5), 2: (1.0, 1.0), 3: (0.5, 1.5)}


def n_words(text: str) -> Column:
    parts = F.split(F.btrim(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(_TRIM)), r"[\x20\x09-\x0D]+")
    return F.when(F.btrim(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(_TRIM)) == "", F.lit(0)).otherwise(F.size(parts)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(key, s) of each source, with its weight, and its target: shares by weight, none above ``MOST`` times its size.

    Handing the excess of capped sources to the others by weight, again and
    again, ends at one level: that at which capped sources give their
    cap and all others their weight times the level.  Sources sorted by the
    level at which they are capped give it in one pass of running sums.
    """
    rank = Window.orderBy("key")
    x = sizes.withColumn("w", (F.row_number().over(rank) - 1) % 3 + 1)
    by = Window.orderBy(MOST * F.col("s") / F.col("w"), "key")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("s").over(everything) - F.coalesce(F.sum(MOST * F.col("s")).over(before), F.lit(0))) / F.sum("w").over(after)
    x = x.withColumn("level", F.when(level <= MOST * F.col("s") / F.col("w"), level))
    x = x.withColumn("level", F.max("level").over(everything))
    # It falls from the first source that isn't capped on, so the right level is the largest that is left.
    return x.select("key", "s", "w", F.least(F.lit(MOST).cast("double") * F.col("s"), F.col("level") * F.col("w")).alias("target"))


def position(share: Column, start: Column, end: Column) -> Column:
    """The time in 0 to 1 at which the integral of a weight from ``start`` to ``end`` has reached ``share`` of its whole."""
    y = share * (start + end) / 2
    root = (F.sqrt(start * start + 2 * (end - start) * y) - start) / (end - start)
    return F.when(start == end, share).otherwise(F.least(root, F.lit(1.0)))


def _mixed(docs: DataFrame, carry: list[str], id: str, text: str, source: str) -> tuple[DataFrame, str, str]:
    """As ``mix``, with a struct (second name returned) that tells rows apart."""
    key, h, bucket, size, name, row = fresh(docs.columns, "mix_key", "mix_h", "mix_bucket", "mix_size", "mix", "mix_row")
    rows = docs.select(
        *[F.col(f"`{c}`") for c in carry],
        F.when(F.col(f"`{source}`").isNull(), F.lit("\U0010ffff")).otherwise(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string"))).alias(key),
        F.xxhash64(F.col(f"`{id}`"), F.col(f"`{text}`")).alias(h),
        n_words(text).alias(size),
    ).withColumn(bucket, F.shiftrightunsigned(h, 52))
    sums = cut(rows.groupBy(F.col(key).alias("key"), F.col(bucket).alias("bucket")).agg(F.sum(size).alias("part")))
    plan = targets(sums.groupBy("key").agg(F.sum("part").alias("s")))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("key", "bucket", F.coalesce(F.sum("part").over(before), F.lit(0)).alias("offset"))
    ramp = {k: F.when(F.col("w") == 1, RAMPS[1][k]).when(F.col("w") == 2, RAMPS[2][k]).otherwise(RAMPS[3][k]) for k in (0, 1)}
    plan = cut(offsets.join(plan, "key").select(F.struct("offset", "s", "target", ramp[0].alias("start"), ramp[1].alias("end")).alias(name), F.col("key").alias(key), F.col("bucket").alias(bucket)))
    place = Window.partitionBy(key, bucket).orderBy(h, F.col(size))
    number = F.struct(F.col(key), F.col(bucket).alias("bucket"), F.row_number().over(place).alias("n"))
    rows = rows.withColumns({row: number, h: F.coalesce(F.sum(size).over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    rows = rows.join(plan, [key, bucket])
    p = F.col(name)
    ratio = F.when(p["s"] > 0, p["target"] / p["s"]).otherwise(0.0)
    full = F.floor(ratio + 1e-9)
    middle = p["offset"] + F.col(h) + F.col(size) / 2
    copies = (full + F.when((F.col(size) > 0) & (middle < (ratio - full) * p["s"]), 1).otherwise(0)).cast("int")
    rows = rows.withColumn(bucket, copies).withColumn(h, middle)
    share = lambda i: F.least((F.col(h) + i * p["s"]) / p["target"], F.lit(1.0))
    places = F.when(F.col(bucket) > 0, F.transform(F.sequence(F.lit(0), F.col(bucket) - 1), lambda i: position(share(i), p["start"], p["end"]))).otherwise(F.array().cast("array<double>"))
    out = F.struct(F.col(size).alias("size"), p["s"].alias("source_size"), p["target"].alias("target"), (F.col(size) * F.col(bucket)).alias("taken"), places.alias("positions"))
    return rows.select(*[F.col(f"`{c}`") for c in carry], F.col(row), out.alias(name)), name, row


def mix(docs: DataFrame, carry: list[str], id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, str]:
    """The columns ``carry`` of each document and a struct (name returned): size, source_size, target, taken, positions.

    A document gets whole passes as often as its source's target holds the
    source, and one more if its place in hash order lies in what remains.
    """
    out, name, row = _mixed(docs, list(dict.fromkeys(carry)), id, text, source)
    return out.drop(row), name


def ranked(docs: DataFrame, carry: list[str], id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, str]:
    """As ``mix``, and ``ranks``: the places (from 0) of the document's copies in the range-sorted order of all copies.

    What it carries is written twice, so carry ids, not texts.
    """
    out, name, row = _mixed(docs, list(dict.fromkeys(carry)), id, text, source)
    out = cut(out)
    copies = out.select(F.col(row).alias("row"), F.explode(F.col(name)["positions"]).alias("at"))
    sorted_ = copies.repartitionByRange("at", "row").sortWithinPartitions("at", "row")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_ = cut(sorted_.select("row", F.spark_partition_id().alias("part"), place.alias("i")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sorted_.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    (ranks,) = fresh(out.columns, "mix_ranks")
    by_row = sorted_.join(F.broadcast(parts), "part").groupBy(F.col("row").alias(row)).agg(F.sort_array(F.collect_list(F.col("offset") + F.col("i"))).alias(ranks))
    out = out.join(by_row, row, "left").withColumn(name, F.col(name).withField("ranks", F.coalesce(F.col(ranks), F.array().cast("array<long>"))))
    return out.drop(row, ranks), name


def curriculum(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as it is taken, range-sorted by training position."""
    out, name = mix(docs, docs.columns, **how)
    (at,) = fresh([*docs.columns, name], "position")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    out = out.select(*cols, F.explode(F.col(name)["positions"]).alias(at))
    return out.repartitionByRange(F.col(at)).sortWithinPartitions(at).select(*cols)
