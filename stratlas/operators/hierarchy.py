"""Trees of regions as tables of (id, parent) rows, and questions about them.

A tree table has an id, a parent id (null at the root) and whatever describes the
node.  Levels are walked by joins, one per level of depth, each materialised;
nothing is collected.
"""

from __future__ import annotations

import difflib

import pandas as pd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratlas.functions.names import words
from stratlas.session import is_small, materialise

MAX_DEPTH = 64
MAX_SPECS = 10_000


def with_paths(nodes: DataFrame, id: str = "id", parent: str = "parent", order: str | None = None) -> DataFrame:
    """Nodes with depth, path (ids from the root down to the node) and order path, from the roots down.

    Rows that no root reaches are dropped; a cycle ends with an error.
    """
    place = F.col(order) if order else F.col(id)
    level = nodes.filter(F.col(parent).isNull()).select("*", F.lit(0).alias("depth"), F.array(F.col(id)).alias("path"), F.array(place).alias("place"))
    out = level = materialise(level)
    for depth in range(1, MAX_DEPTH + 2):
        above = level.select(F.col(id).alias("_up"), F.col("path").alias("_path"), F.col("place").alias("_place"))
        level = nodes.join(above, F.col(parent) == F.col("_up")).select(
            *[nodes[c] for c in nodes.columns], F.lit(depth).alias("depth"), F.array_append("_path", F.col(id)).alias("path"), F.array_append("_place", place).alias("place")
        )
        level = materialise(level)
        if level.isEmpty():
            return out
        out = out.union(level)
    raise ValueError(f"a path is longer than {MAX_DEPTH}")


def closure(tree: DataFrame, id: str = "id") -> DataFrame:
    """(ancestor, descendant, distance) of every pair on a path, each node with itself at distance 0."""
    return tree.select(F.col(id).alias("descendant"), F.size("path").alias("n"), F.posexplode("path").alias("at", "ancestor")).select("ancestor", "descendant", (F.col("n") - 1 - F.col("at")).alias("distance"))


def is_ancestor(path: Column, ancestor: Column) -> Column:
    """``ancestor`` is on a node's path, above it or itself."""
    return F.array_contains(path, ancestor)


def subtree(tree: DataFrame, root) -> DataFrame:
    """A node and all below, detached: paths and depths start at it."""
    at = F.array_position("path", F.lit(root)).cast("int")
    inside = tree.filter(F.array_contains("path", F.lit(root)))
    return inside.withColumns({"depth": F.col("depth") - at + 1, "place": F.slice("place", at, F.size("place")), "path": F.slice("path", at, F.size("path"))})


def preorder(tree: DataFrame, root: Column | None = None) -> DataFrame:
    """Trees with each node's number in pre-order within its tree, from 0."""
    root = F.get("path", F.lit(0)) if root is None else root
    return tree.withColumn("preorder", F.row_number().over(Window.partitionBy(root).orderBy("place")) - 1)


def render(depth: Column, name: Column) -> Column:
    return F.concat(F.repeat(F.lit("  "), depth), name)


def prune(tree: DataFrame, matched: DataFrame, topmost: bool = False, id: str = "id", parent: str = "parent") -> DataFrame:
    """Of matched ids: without those whose parent matched, unless they have matched children themselves.

    ``topmost`` adds parents all of whose children are left, and then drops what
    stands below another of the result.
    """
    hit = matched.select(F.col(id).alias("hit")).distinct()
    nodes = tree.select(F.col(id).alias("n"), F.col(parent).alias("p"))
    inside = nodes.join(hit, F.col("n") == F.col("hit")).select("n", "p")
    mothers = inside.filter("p is not null").select(F.col("p").alias("m")).distinct()
    kept = inside.join(mothers, F.col("n") == F.col("m"), "left").join(hit, F.col("p") == F.col("hit"), "left").filter("m is not null or hit is null").select("n", "p")
    if topmost:
        kept = materialise(kept)
        full = nodes.filter("p is not null").join(kept.select(F.col("n").alias("k")), F.col("n") == F.col("k"), "left").groupBy("p").agg(F.bool_and(F.col("k").isNotNull()).alias("all")).filter("all").select(F.col("p").alias("n"))
        both = materialise(kept.select("n").union(full).distinct().join(nodes, "n"))
        above = both.select(F.col("n").alias("up"))
        kept = both.join(above, F.col("p") == F.col("up"), "left_anti")
    return kept.select(F.col("n").alias(id))


def find(tree: DataFrame, match: Column, filter_children: bool = False, find_topmost: bool = False, id: str = "id", parent: str = "parent") -> DataFrame:
    """The nodes that match, pruned if asked for, shallow ones first."""
    matched = tree.filter(match)
    if filter_children:
        matched = tree.join(prune(tree, matched, find_topmost, id, parent), id, "left_semi")
    return matched.orderBy("depth", id)


@F.pandas_udf(T.DoubleType())
def name_similarity(name: pd.Series, spec: pd.Series) -> pd.Series:
    """Ratio of the longest matching blocks of two strings, 0 to 1."""
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(name, spec, strict=True)])


def ranked(found: DataFrame, spec: str, name: str = "name", id: str = "id") -> DataFrame:
    """Found nodes, names most like the spec first; ties by depth, then id."""
    return found.withColumn("similarity", name_similarity(F.col(name), F.lit(spec))).orderBy(F.desc("similarity"), "depth", id)


def resolve(tree: DataFrame, specs: DataFrame, match: Column, id: str = "id", parent: str = "parent", name: str = "name", key: str = "key") -> DataFrame:
    """One row per spec: how many nodes it means, and the node if there is exactly one.

    ``specs`` has a column spec, and ``match`` is a condition on spec and node.
    A node of exactly this name or key is taken at once (the first, if several);
    else matches are pruned, and if more remain, the one all of whose words are
    in the spec, if only one is such.  Specs are what a user asks for: more than
    ``MAX_SPECS`` are refused.
    """
    if not is_small(specs, MAX_SPECS):
        raise ValueError(f"more than {MAX_SPECS} specs")
    pairs = materialise(tree.join(F.broadcast(specs), match | (F.col("spec") == F.col(name)) | (F.col("spec") == F.col(key))))
    exact = pairs.filter((F.col("spec") == F.col(name)) | (F.col("spec") == F.col(key))).groupBy("spec").agg(F.min_by(id, F.struct("depth", id)).alias("exact"))
    hit = pairs.filter(match).select("spec", F.col(id).alias("n"), F.col(parent).alias("p"), F.col(name).alias("name"))
    up = hit.select(F.col("spec").alias("s2"), F.col("n").alias("n2"))
    mothers = hit.filter("p is not null").select(F.col("spec").alias("s3"), F.col("p").alias("p3")).distinct()
    kept = hit.join(up, (F.col("spec") == F.col("s2")) & (F.col("p") == F.col("n2")), "left").join(mothers, (F.col("spec") == F.col("s3")) & (F.col("n") == F.col("p3")), "left")
    kept = kept.filter("n2 is null or p3 is not null")
    asked = words(F.lower(F.replace(F.col("spec"), F.lit(","), F.lit(""))), " ")
    have = words(F.lower("name"), " ")
    kept = kept.withColumn("full", F.size(F.array_except(have, asked)) == 0)
    found = kept.groupBy("spec").agg(F.count("*").alias("n"), F.min("n").alias("only"), F.count_if("full").alias("full"), F.min(F.when(F.col("full"), F.col("n"))).alias("best"))
    out = specs.select("spec").distinct().join(exact, "spec", "left").join(found, "spec", "left")
    chosen = F.coalesce(F.col("exact"), F.when(F.col("n") == 1, F.col("only")), F.when(F.col("full") == 1, F.col("best")))
    return out.select("spec", F.when(F.col("exact").isNotNull() | (F.col("full") == 1), F.lit(1)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("matches"), chosen.alias(id))


def covered(tree: DataFrame, own: DataFrame, scope: str, id: str = "id", parent: str = "parent") -> DataFrame:
    """(scope, id): nodes that are themselves in ``own``, or all of whose children are, all the way up."""
    children = tree.filter(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("p")).agg(F.count("*").alias("n"))
    nodes = tree.select(F.col(id).alias("c"), F.col(parent).alias("p"))
    have = materialise(own.select(scope, F.col(id).alias("c")).distinct())
    for _ in range(MAX_DEPTH):
        full = have.join(nodes, "c").groupBy(scope, "p").agg(F.count("*").alias("k")).join(children, "p").filter("k = n").select(scope, F.col("p").alias("c"))
        new = materialise(full.join(have, [scope, "c"], "left_anti"))
        if new.isEmpty():
            return have.select(scope, F.col("c").alias(id))
        have = materialise(have.union(new))
    raise ValueError(f"a path is longer than {MAX_DEPTH}")


def mask_sources(tree: DataFrame, mapped: DataFrame, id: str = "id") -> DataFrame:
    """(id, source): of every region the mapped regions that its mask is made of: itself, or else the nearest mapped ones below it."""
    own = mapped.select(F.col(id).alias("source")).distinct()
    up = tree.join(own, F.col(id) == F.col("source")).select("source", F.posexplode("path").alias("at", "above"))
    nearest = up.filter("above <> source").join(own.select(F.col("source").alias("above")), "above", "left_semi").groupBy("source").agg(F.max("at").alias("last"))
    return up.join(nearest, "source", "left").filter("last is null or at > last").select(F.col("above").alias(id), "source")


def own_or_parent(tree: DataFrame, value: str, id: str = "id", parent: str = "parent") -> DataFrame:
    """(id, value): a node's own value, or else its parent's."""
    up = tree.select(F.col(id).alias("_up"), F.col(value).alias("_above"))
    return tree.join(up, F.col(parent) == F.col("_up"), "left").select(id, F.coalesce(value, "_above").alias(value))


def version_chain(items: DataFrame, name: str, version: str) -> DataFrame:
    """Rows with their neighbours by version within a name, and whether none is newer; numeric parts compare as numbers."""
    numbers = F.transform(F.regexp_extract_all(F.col(version), F.lit(r"(\d+)"), F.lit(1)), lambda v: v.cast("long"))
    order = Window.partitionBy(name).orderBy(numbers, version)
    return items.withColumns({"previous": F.lag(version).over(order), "next": F.lead(version).over(order)}).withColumn("newest", F.col("next").isNull())


def translated(relations: DataFrame, source: DataFrame, id: str = "id") -> DataFrame:
    """Ids in relation to the given ones, both ways, with the relation's code: (id, related, code)."""
    both = relations.select("a", "b", "code").union(relations.select(F.col("b").alias("a"), F.col("a").alias("b"), "code"))
    return both.join(source.select(F.col(id).alias("a")).distinct(), "a").filter("a <> b").select(F.col("a").alias(id), F.col("b").alias("related"), "code").distinct()
