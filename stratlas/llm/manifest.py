"""Merkle manifest of a dataset: one digest for all rows, and a proof for each.

Leaves are digests of the rows' fields.  The leaves of one tree key, in id order,
are folded two by two to the key's subroot; subroots in key order are folded to
the root.  A proof is the list of siblings from a leaf to the root.

1. Leaves are made in the scan, so texts never move.  Ranges of (key, id) give
   each leaf its place: sorted ranges are written once, and a place is the row's
   number in its range plus what lies before it.
2. Aligned blocks of ``2 ** LEVELS`` leaves are folded to one node each, and the
   nodes are leaves of the tier above, until every tree is one block.  The same
   is done with the subroots.
3. From the top tier down, each block emits the authentication path of its
   leaves in order: one treehash stack a level prepares the next sibling while
   paths are emitted (``paths``), so the nodes that a block holds are
   logarithmic in its leaves.  The block's own upper path, the same for all its
   leaves, is appended.

A block is at most ``2 ** LEVELS`` rows, whatever a key's size; no step gathers
a tree.

Defined cases: nulls are a mark of their own in a leaf; a null id comes first,
equal ids are ordered by leaf, and rows that are equal in all fields are
interchangeable leaves; a key with one leaf is its own subroot; an empty table has
no root and gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratlas.llm.textops import cut, fresh

LEVELS = 10


def join_hash(parts: list[str]) -> str:
    """The node above: hexadecimal digest of the hexadecimal digests below, one after the other."""
    return sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A field in a leaf: its length in bytes and its value, or a mark for null."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(f) for f in fields]).cast("binary"), 256)


class Treehash:
    """One node of a level, made leaf by leaf on a stack of at most ``level + 1`` nodes.

    Where the leaves end inside the node, what is there is hashed alone to the
    level; a node that starts behind the last leaf is None.
    """

    def __init__(self, leaves: list[str], level: int, start: int):
        self.leaves, self.level, self.next = leaves, level, start
        self.end = min(start + (1 << level), len(leaves))
        self.stack: list[tuple[str, int]] = []
        self.done = start >= len(leaves)

    @property
    def tail(self) -> int:
        """Height of the lowest node on the stack; what is done never goes first."""
        return 1 << 30 if self.done else self.stack[-1][1] if self.stack else self.level

    def finish(self) -> str | None:
        while not self.done:
            self.step()
        return self.stack[0][0] if self.stack else None

    def step(self) -> None:
        """One leaf, or one hash."""
        s = self.stack
        if len(s) > 1 and s[-1][1] == s[-2][1]:
            (right, height), (left, _) = s.pop(), s.pop()
            s.append((join_hash([left, right]), height + 1))
        elif self.next < self.end:
            s.append((self.leaves[self.next], 0))
            self.next += 1
        else:
            node, height = s.pop()
            s.append((join_hash([node]), height + 1))
        self.done = len(s) == 1 and s[0][1] == self.level and self.next >= self.end


def fold(leaves: list[str], height: int) -> str:
    """The node over all leaves."""
    return Treehash(leaves, height, 0).finish()


def paths(leaves: list[str], height: int) -> Iterator[list[str | None]]:
    """The siblings of each leaf from the bottom up to ``height``, leaf by leaf; None where a node is alone.

    When leaf i + 1 is a multiple of 2 ** h, the sibling at level h changes to the
    node that the level's stack has ready, and the stack starts on the one after
    that.  Between two leaves 2 * height - 1 steps go to the stack whose lowest
    node is lowest, which makes every node in time.
    """
    auth = [Treehash(leaves, h, 1 << h).finish() for h in range(height)]
    stacks = [Treehash(leaves, h, 0) for h in range(height)]
    for s in stacks:
        s.finish()
    for i in range(len(leaves)):
        yield list(auth)
        for h in range(height):
            if (i + 1) % (1 << h) == 0:
                auth[h] = stacks[h].finish()
                stacks[h] = Treehash(leaves, h, (i + 1 + (1 << h)) ^ (1 << h))
        for _ in range(2 * height - 1):
            least = min(stacks, key=lambda s: s.tail)
            if least.done:
                break
            least.step()


def above(node: Column, proof: Column) -> Column:
    """What a leaf's digest and a proof give: a sibling is marked L or R by its side, and is empty where the node is alone."""
    h = lambda *parts: F.sha2(F.concat(*parts).cast("binary"), 256)
    other = lambda s: F.substring(s, 2, 64)
    return F.aggregate(proof, node, lambda n, s: F.when(s == "", h(n)).when(F.startswith(s, F.lit("L")), h(other(s), n)).otherwise(h(n, other(s))))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.substring(s, 2, 64)), "").cast("binary"), 256)


def placed(nodes: DataFrame, tree: str, *order: str) -> DataFrame:
    """``nodes`` with their place in their tree (from 0) and the tree's number of nodes, as ``place`` and ``count``.

    Rows of one tree are dealt over many ranges; equal ones as well, by their place in the input.
    """
    row, part = "_row", "_part"
    sorted_ = nodes.withColumn(row, F.monotonically_increasing_id())
    keys = [tree, *order, row]
    sorted_ = cut(sorted_.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(row))
    sorted_ = sorted_.withColumns({row: F.monotonically_increasing_id(), part: F.spark_partition_id()})
    runs = cut(sorted_.groupBy(tree, part).agg(F.count("*").alias("_n"), F.min(row).alias("_first")))
    before = Window.partitionBy(tree).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(tree)
    runs = runs.select(tree, part, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"), F.sum("_n").over(whole).alias("count"))
    out = sorted_.join(runs, [tree, part]).withColumn("place", F.col(row) + F.col("_offset"))
    return out.drop(row, part, "_offset")


def _height(count: int, levels: int) -> int:
    """Levels of one block of a tree of ``count`` nodes."""
    return min(levels, (count - 1).bit_length())


def _folder(levels: int):
    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        n, block = t.column("count")[0].as_py(), t.column("block")[0].as_py()
        node = fold(t.column("node").to_pylist(), _height(n, levels))
        return pa.table({"tree": t.column("tree").slice(0, 1), "place": [block], "node": [node], "count": [(n + (1 << levels) - 1) >> levels]})

    return one


def _walker(levels: int, names: list[str]):
    """A block's rows with their proofs: the path inside of the block and then the block's own, which ``up`` has with the digests above."""

    def walk(t: pa.Table, up: pa.Table) -> pa.Table:
        t, up = t.sort_by("place"), up.to_pylist()[0]
        height = _height(t.column("count")[0].as_py(), levels)
        proofs = []
        for i, path in enumerate(paths(t.column("node").to_pylist(), height)):
            proofs.append(["" if s is None else ("L" if i >> h & 1 else "R") + s for h, s in enumerate(path)] + up["proof"])
        t = t.append_column("proof", pa.array(proofs, pa.list_(pa.string())))
        for c in names[len(t.column_names) :]:
            t = t.append_column(c, pa.array([up[c]] * t.num_rows, pa.string()))
        return t

    return walk


def tiers(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """(tree, place, node, count, block) of every tier: the leaves with their other columns, then what their blocks fold to, up to one node a tree."""
    out = []
    while len(out) < 2 or not out[-1].filter("count > 1").isEmpty():
        if out:
            nodes = out[-1].select("tree", "place", "node", "count", "block").groupBy("tree", "block").applyInArrow(_folder(levels), "tree string, place long, node string, count long")
        out.append(cut(nodes.withColumn("block", F.shiftright("place", levels)).repartition("tree", "block")))
    return out


def proofs(tiers: list[DataFrame], up: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The leaves with ``proof`` and the digests of ``up``, which has (tree, block, proof, digests) of what stands above each tree's last node."""
    digests = [c for c in up.columns if c not in ("tree", "block", "proof")]
    for t in reversed(tiers[:-1]):
        kinds = T.StructType([*t.schema, up.schema["proof"], *[up.schema[c] for c in digests]])
        walked = t.groupBy("tree", "block").cogroup(up.groupBy("tree", "block")).applyInArrow(_walker(levels, kinds.names), kinds)
        if t is not tiers[0]:
            up = cut(walked.select("tree", F.col("place").alias("block"), "proof", *digests))
    return walked


def manifest(docs: DataFrame, carry: list[str], fields: list[str], id: str = "doc_id", tree: str = "lang", levels: int = LEVELS) -> tuple[DataFrame, str]:
    """The columns ``carry`` of each row and a struct (name returned): leaf, subroot, root, proof."""
    (name,) = fresh(carry, "merkle")
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{tree}`").cast("string")), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([*carry, id])]).alias("row")
    leaves = docs.select(key.alias("tree"), F.col(f"`{id}`").alias("id"), leaf([F.col(f"`{c}`") for c in fields]).alias("node"), row)
    low = tiers(placed(leaves, "tree", "id", "node").drop("id"), levels)
    high = tiers(placed(low[-1].select(F.lit("").alias("tree"), F.col("tree").alias("key"), "node"), "tree", "key"), levels)
    top = high[-1].select("tree", "block", F.array().cast("array<string>").alias("proof"), F.col("node").alias("root"))
    up = proofs(high, top, levels).select(F.col("key").alias("tree"), F.lit(0).cast("long").alias("block"), "proof", F.col("node").alias("subroot"), "root")
    out = proofs(low, cut(up), levels)
    result = F.struct(F.col("node").alias("leaf"), "subroot", "root", "proof")
    return out.select(*[F.col("row").getField(c).alias(c) for c in dict.fromkeys(carry)], result.alias(name)), name
