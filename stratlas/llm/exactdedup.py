"""Exact duplicates: rows by a 128-bit content hash, the smallest id of equal texts stays.

1. Each row's normalised text (every run of white space is one space) gives two
   64-bit hashes.  Counts by hash move ids and hashes only, and a task's copies
   are one row before the shuffle.
2. Only rows whose hash occurs again are compared: grouping by hash and text
   compares bytes, and copies in one task are one row of that grouping, so the
   texts of a large group of copies don't meet.  Hashes that occur again are
   sent to all executors if they are ``BROADCAST_HASHES`` at most, else joined.
3. Rows take their class by the hash.  If one hash has different texts, the rows
   of such hashes (and only these) take it by hash and text.

Defined cases: a null text is an empty one; a null id never stays for others and
rows without any id stay, all of them; rows that share id and text stay or go
together; an empty table gives an empty result; very long texts are hashed
whole; other columns are carried if asked for and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratlas.llm.neardup import copied, dealt, hot_slots
from stratlas.llm.textops import cut, fresh

#: So many hashes (16 bytes each) are sent to all executors; more are joined by shuffle.
BROADCAST_HASHES = 1_000_000


def normalised(text: str) -> Column:
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def content_hash(t: Column) -> Column:
    """128 bits: two hashes of the text with different seeds."""
    return F.struct(F.xxhash64(t).alias("h1"), F.xxhash64(F.lit("second"), t).alias("h2"))


def duplicates(docs: DataFrame, carry: list[str], id: str = "doc_id", text: str = "text", hashed=content_hash) -> tuple[DataFrame, str]:
    """The columns ``carry`` of each row and a struct (name returned): keep_id, group_size, kept, text_sha256."""
    (name,) = fresh(carry, "exact")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([*carry, id])]).alias("row"), F.col(f"`{id}`").alias("id"), normalised(text).alias("t"), F.monotonically_increasing_id().alias("i"))
    rows = rows.withColumn("h", hashed(F.col("t")))

    again = cut(rows.groupBy("h").agg(F.count("*").alias("rows")).filter("rows > 1"))
    slots = hot_slots(again, "h")
    few = again.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES
    wanted = again.select("h")
    same = rows.select("id", "t", "h").join(F.broadcast(wanted) if few else wanted, "h", "left_semi")
    classes = cut(same.groupBy("h", "t").agg(F.min("id").alias("keep"), F.count("*").alias("size")))
    by_h = classes.groupBy("h").agg(F.count("*").alias("texts"), F.first("keep").alias("keep"), F.first("size").alias("size"))
    odd = cut(by_h.filter("texts > 1").select("h"))

    sha = F.sha2(F.col("t").cast("binary"), 256).alias("sha")
    out = dealt(rows.select("row", "id", sha, "h", "i"), slots, "h", "i").join(copied(by_h.filter("texts = 1").drop("texts"), slots, "h"), ["h", "salt"], "left").drop("salt", "i")
    if not odd.isEmpty():
        by_text = rows.join(odd, "h", "left_semi").join(classes, ["h", "t"]).select("h", "row", "id", sha, "keep", "size")
        out = out.join(odd, "h", "left_anti").unionByName(by_text)
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep"))
    result = F.struct(keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in dict.fromkeys(carry)], result.alias(name)), name


def deduplicate(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that stay."""
    out, name = duplicates(docs, docs.columns, **how)
    return out.filter(F.col(name)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
