"""Hierarchical density clusters of point clouds of any size, from a distributed spanning tree.

1. Points in the order of a space-filling curve are cut into leaves of ``LEAF``
   points: one row a leaf, with its box.  All later passes pair leaves whose boxes
   are near and compare a pair's points at once.
2. The core distance of a point is the distance to its k-th neighbour.  A leaf
   looks at leaves within a radius, nearest first, and keeps k + 1 distances a
   point; leaves with a point that isn't settled look again twice as far.
3. The spanning tree of mutual reachability (the largest of both core distances
   and the distance) grows by rounds: each component's least edge to another one
   joins both.  A component's search reaches to its own radius; one that finds
   nothing within it looks farther in the next round.  Of edges as long as each
   other those to denser points come first, so the first round leaves about one
   component for each local maximum of density.
4. The tree is followed from its shortest edges only until a component has the
   smallest size of a cluster: two components that are each other's least edge
   join, and one whose least edge leads to a cluster joins that.  Rounds end when
   ``FINISH`` edges are left, which one task follows.  What remains are the edges
   between clusters, at most as many as points by the smallest size.
5. The clusters' tree of one cloud is a few rows (at most cloud size by smallest
   cluster); the points' densities are summed over all points by cluster.

Edges of equal length count at once: a component that comes to be a cluster at the
length at which it joins another one is none.

Defined cases: points without three finite coordinates are noise and counted
nowhere; equal points are points of their own; clouds smaller than the smallest
cluster are noise; clusters are numbered by their smallest index; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratlas.operators import locations
from stratlas.operators.components import connected_components
from stratlas.operators.locations import HIGH, LOW, XYZ
from stratlas.session import Scratch, bounded_batches, is_small, materialise

#: Points in a leaf, and the bits of a point's number there.
LEAF, BITS = 1024, 11
#: Distances that a pass keeps for the points that it has in work (8 bytes each).
KEPT = 1 << 21
MAX_ROUNDS = 300
#: So many edges of the tree are followed in one task, when rounds have left no more.
FINISH = 500_000
#: Tables of at most so many rows are sent to all executors.
SMALL = 100_000


def _spread(v: Column) -> Column:
    """The low 20 bits of a number, two places apart."""
    v = v.cast("long")
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_small(df, SMALL) else df


def _packer(size: int, names: list[str]):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held = TaskContext.get().partitionId(), 0, None

        def leaf(t: pa.Table) -> pa.RecordBatch:
            xyz = np.column_stack([t.column(c).to_numpy() for c in XYZ])
            low, high = xyz.min(0), xyz.max(0)
            row = {"leaf": [part << 31 | n], "g": t.column("g").slice(0, 1), "k": t.column("k").slice(0, 1), "n": [len(xyz)], "extent": t.column("extent").slice(0, 1), "whole": t.column("whole").slice(0, 1)}
            row |= {c: [v] for c, v in zip((*LOW, *HIGH), (*low, *high), strict=True)}
            row |= {"ids": pa.array([t.column("idx").to_pylist()], pa.list_(t.schema.field("idx").type)), "xyz": pa.array([xyz.tobytes()], pa.binary())}
            return pa.table({x: row[x] for x in names}).combine_chunks().to_batches()[0]

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            cloud = held.column("g").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            start = 0
            while start < held.num_rows:
                others = np.flatnonzero(cloud[start:] != cloud[start])
                end = start + int(others[0]) if len(others) else held.num_rows
                stop = min(end, start + size)
                if stop == held.num_rows and stop - start < size:
                    break
                yield leaf(held.slice(start, stop - start))
                n, start = n + 1, stop
            held = held.slice(start) if start < held.num_rows else None
        if held is not None:
            yield leaf(held)

    return pack


def leaves(points: DataFrame, least: float, size: int = LEAF) -> DataFrame:
    """Rows (leaf, g, k, n, extent, whole, box, ids, xyz) of points (g, idx, x, y, z)."""
    aggs = [f(c).alias(name) for c in XYZ for f, name in ((F.min, "_lo" + c), (F.max, "_hi" + c))]
    ends = materialise(points.groupBy("g").agg(F.count("*").alias("_n"), *aggs))
    side = F.greatest(*[F.col("_hi" + c) - F.col("_lo" + c) for c in XYZ])
    ends = ends.select(F.col("g").alias("_g"), F.greatest(F.lit(2), F.floor(F.col("_n") * least)).cast("long").alias("k"), F.col("_n").alias("whole"), side.alias("extent"), *["_lo" + c for c in XYZ])
    p = points.join(_broadcast(ends), F.col("g").eqNullSafe(F.col("_g"))).drop("_g")
    cell = lambda c: F.when(F.col("extent") > 0, F.least(F.floor((F.col(c) - F.col("_lo" + c)) / F.col("extent") * (1 << 20)), F.lit((1 << 20) - 1))).otherwise(0)
    code = sum((F.shiftleft(_spread(cell(c)), i) for i, c in enumerate(XYZ)), F.lit(0))
    p = p.filter("whole >= k").select("g", "idx", *XYZ, "k", "extent", "whole", code.alias("code"), F.monotonically_increasing_id().alias("at"))
    p = p.repartitionByRange("g", "code", "at").sortWithinPartitions("g", "code", "at").drop("code", "at")
    kinds = T.StructType(
        [T.StructField("leaf", T.LongType()), p.schema["g"], T.StructField("k", T.LongType()), T.StructField("n", T.LongType()), T.StructField("extent", T.DoubleType()), T.StructField("whole", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in (*LOW, *HIGH)]
        + [T.StructField("ids", T.ArrayType(p.schema["idx"].dataType)), T.StructField("xyz", T.BinaryType())]
    )
    return materialise(p.mapInArrow(_packer(size, kinds.names), kinds))


def _near(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (q, t) of leaves of one cloud of which the second reaches into the ``radius`` of the first, without pairs within one component (``only``).

    Boxes of up to ``SMALL`` leaves are sent to all executors, and each leaf looks through them; more are joined by grid cells.
    """
    box = [*LOW, *HIGH]
    if is_small(b, SMALL):
        cloud = {}
        rows = b.select(F.xxhash64("g").alias("g"), "leaf", "only", *box).toArrow()
        g = rows.column("g").to_numpy()
        order = np.argsort(g, kind="stable")
        values = [rows.column(c).to_numpy()[order] for c in ("leaf", *box)]
        only = rows.column("only").fill_null(-1).to_numpy()[order]
        cuts = np.flatnonzero(np.append(True, np.diff(g[order]) != 0)).tolist() + [len(g)] if len(g) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            cloud[int(g[order][lo])] = (values[0][lo:hi], np.column_stack([v[lo:hi] for v in values[1:4]]), np.column_stack([v[lo:hi] for v in values[4:]]), only[lo:hi])
        return a.select("leaf", F.xxhash64("g").alias("g"), "radius", "only", *box).mapInArrow(_looker(cloud), "q long, t long")
    pad = F.col("radius") * (1 + 1e-9) + F.col("extent") * 1e-12 + 1e-300
    thin = F.col("extent") * 1e-12 + 1e-300
    grown = lambda df, by, name: df.select(F.struct("g").alias("g"), F.col("leaf").alias(name), *[(F.col(c) - by).alias(c) for c in LOW], *[(F.col(c) + by).alias(c) for c in HIGH])
    met = locations.intersect_boxes(grown(a, pad, "q"), grown(b, thin, "t"), "q", "t", on=("g",)).select("q", "t")
    met = met.join(a.select(F.col("leaf").alias("q"), F.col("only").alias("o1")), "q").join(b.select(F.col("leaf").alias("t"), F.col("only").alias("o2")), "t")
    return met.filter("o1 is null or o2 is null or o1 <> o2").select("q", "t")


def _looker(cloud: dict[int, tuple[np.ndarray, ...]]):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                leaf, low, high, only = cloud[r["g"]]
                lo, hi = np.array([r[c] for c in LOW]), np.array([r[c] for c in HIGH])
                gap = np.maximum(np.maximum(low - hi, lo - high), 0)
                good = np.sqrt((gap * gap).sum(1)) <= r["radius"] * (1 + 1e-9) + 1e-300
                if r["only"] is not None:
                    good &= only != r["only"]
                yield pa.RecordBatch.from_pydict({"q": np.full(int(good.sum()), r["leaf"]), "t": leaf[good]})

    return look


def _gap(xyz: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distance of points to a box, not more than that to any point inside."""
    d = np.maximum(np.maximum(low - xyz, xyz - high), 0)
    return np.sqrt((d * d).sum(1)) * (1 - 1e-12)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt((a[:, None, 0] - b[None, :, 0]) ** 2 + (a[:, None, 1] - b[None, :, 1]) ** 2 + (a[:, None, 2] - b[None, :, 2]) ** 2)


def _points(raw) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, 3)


def _core(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Core distances of query parts (q, s) whose targets come in a row; NaN where the radius doesn't settle a point."""
    part, best, points, k, radius = None, None, None, 0, 0.0

    def done() -> pa.RecordBatch:
        kth = best[:, k] if best.shape[1] > k else np.full(len(best), np.nan)
        kth = np.where(kth <= radius, kth, np.nan)
        return pa.RecordBatch.from_pydict({"q": [part[0]], "s": [part[1]], "core": pa.array([kth.tobytes()], pa.binary())})

    for batch in batches:
        for r in batch.to_pylist():
            if (r["q"], r["s"]) != part:
                if part is not None:
                    yield done()
                part, k, radius = (r["q"], r["s"]), r["last"], r["radius"]
                points = _points(r["xyz"])[r["s"] * r["step"] : (r["s"] + 1) * r["step"]]
                best = np.zeros((len(points), 0))
            other = _points(r["other"])
            kth = best[:, k] if best.shape[1] > k else np.full(len(points), np.inf)
            some = np.flatnonzero(_gap(points, other.min(0), other.max(0)) < np.minimum(kth, radius * (1 + 1e-9) + 1e-300))
            if best.shape[1] <= k:  # rows differ in length: the rest is far
                new = np.full((len(points), len(other)), np.inf)
                new[some] = distances(points[some], other)
                best = np.concatenate([best, new], axis=1)
                if best.shape[1] > k + 1:
                    best = np.partition(best, k, axis=1)[:, : k + 1]
            elif len(some):
                both = np.concatenate([best[some], distances(points[some], other)], axis=1)
                best[some] = np.partition(both, k, axis=1)[:, : k + 1]
    if part is not None:
        yield done()


def core_distances(tree: DataFrame) -> DataFrame:
    """The leaves with ``core`` of their points, and as ``radius`` the largest."""
    bounded_batches(tree.sparkSession)
    last = F.least(F.col("k"), F.col("whole") - 1)
    step = F.greatest(F.lit(16), F.floor(F.lit(KEPT) / (last + 1))).cast("long")
    diagonal = F.sqrt(sum(((F.col(b) - F.col(a)) * (F.col(b) - F.col(a)) for a, b in zip(LOW, HIGH, strict=True)), F.lit(0.0)))
    guess = F.greatest(diagonal * F.greatest(F.lit(1.0), F.pow((last + 1) / F.col("n"), F.lit(1 / 3))), F.col("extent") * 1e-6)
    left = materialise(tree.withColumns({"last": last, "step": step, "radius": guess, "only": F.lit(None).cast("long")}))
    all_, found = left, None
    for _ in range(MAX_ROUNDS):
        q = left.select(F.col("leaf").alias("q"), "last", "step", "radius", "xyz", *[F.col(c).alias("_" + c) for c in (*LOW, *HIGH)], F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("step")))).alias("s"))
        t = all_.select(F.col("leaf").alias("t"), F.col("xyz").alias("other"), *LOW, *HIGH)
        apart = sum((F.pow(F.greatest(F.col("_" + a) - F.col(b), F.col(a) - F.col("_" + b), F.lit(0.0)), 2) for a, b in zip(LOW, HIGH, strict=True)), F.lit(0.0))
        rows = _near(left, all_).join(q, "q").join(t, "t").select("q", "s", "last", "step", "radius", "xyz", "other", apart.alias("apart"))
        rows = rows.repartition("q", "s").sortWithinPartitions("q", "s", "apart").drop("apart")
        parts = rows.mapInArrow(_core, "q long, s long, core binary").groupBy("q").agg(F.sort_array(F.collect_list(F.struct("s", "core"))).alias("parts"))
        parts = materialise(parts.select(F.col("q").alias("leaf"), "parts").mapInArrow(_joined, "leaf long, core binary, radius double, open boolean"))
        good = parts.filter("not open").select("leaf", "core", F.col("radius").alias("most"))
        found = good if found is None else found.union(good)
        left = materialise(left.join(parts.filter("open").select("leaf"), "leaf", "left_semi").withColumn("radius", F.col("radius") * 2))
        if left.isEmpty():
            return materialise(tree.join(found.withColumnRenamed("most", "radius"), "leaf"))
    raise RuntimeError(f"core distances are open after {MAX_ROUNDS} rounds")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            core = np.concatenate([np.frombuffer(p["core"], np.float64) for p in r["parts"]])
            open_ = bool(np.isnan(core).any())
            yield pa.RecordBatch.from_pydict({"leaf": [r["leaf"]], "core": pa.array([core.tobytes()], pa.binary()), "radius": [0.0 if open_ else float(core.max())], "open": [open_]})


def _relabel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaf rows with the new component of each point and the largest radius of them."""
    for batch in batches:
        for r in batch.to_pylist():
            names = sorted((n["old"], n["new"]) for n in r["names"])
            old, new = (np.array(v, np.int64) for v in zip(*names, strict=True))
            comp = new[np.searchsorted(old, np.frombuffer(r["comp"], np.int64))]
            only = int(comp[0]) if (comp == comp[0]).all() else None
            yield pa.RecordBatch.from_pydict({"leaf": [r["leaf"]], "comp": pa.array([comp.tobytes()], pa.binary()), "comps": pa.array([np.unique(comp).tolist()], pa.list_(pa.int64())), "only": pa.array([only], pa.int64())})


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a pair of leaves, the least edge of each component of the first to another one in the second."""
    for batch in batches:
        for r in batch.to_pylist():
            a, b = _points(r["xyz"]), _points(r["txyz"])
            core, tcore, comp, tcomp = np.frombuffer(r["core"]), np.frombuffer(r["tcore"]), np.frombuffer(r["comp"], np.int64), np.frombuffer(r["tcomp"], np.int64)
            some = np.flatnonzero(_gap(a, b.min(0), b.max(0)) <= r["radius"])
            for at in np.array_split(some, max(1, -(-len(some) * len(b) // (1 << 20)))):
                if not len(at):
                    continue
                w = np.maximum(np.maximum(distances(a[at], b), core[at, None]), tcore[None, :])
                w[comp[at, None] == tcomp[None, :]] = np.inf
                low = w.min(1)
                fine = np.isfinite(low)
                at, w, low = at[fine], w[fine], low[fine]
                if not len(at):
                    continue
                denser = np.where(w == low[:, None], np.minimum(core[at, None], tcore[None, :]), np.inf)
                j = denser.argmin(1)  # the first of several has the smallest number
                lc = denser[np.arange(len(at)), j]
                p, q = (r["q"] << BITS) + at, (r["t"] << BITS) + j
                x, y = np.minimum(p, q), np.maximum(p, q)
                order = np.lexsort((y, x, lc, low, comp[at]))
                c = comp[at][order]
                first = order[np.append(True, c[1:] != c[:-1])]
                yield pa.RecordBatch.from_pydict({"comp": comp[at][first], "w": low[first], "lc": lc[first], "a": x[first], "b": y[first], "other": tcomp[j[first]]})


def spanning_tree(tree: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b, length) between point numbers, one fewer than points in each cloud."""
    bounded_batches(tree.sparkSession)
    pack = "leaf long, comp binary, comps array<long>, only long"
    tree = scratch.table(tree)
    comps = scratch.table(tree.select("leaf", "core", "extent", "whole").mapInArrow(_singles, "comp long, rho double, tiny double, n long, whole long"))
    state = scratch.table(tree.select("leaf", "n").mapInArrow(_numbers, pack))
    clouds = tree.select("g").distinct().count()
    fixed = tree.select("leaf", "g", "extent", *LOW, *HIGH)
    edges = None
    for _ in range(MAX_ROUNDS):
        if comps.count() <= clouds:
            return edges if edges is not None else tree.sparkSession.createDataFrame([], "a long, b long, length double")
        reach = state.select("leaf", F.explode("comps").alias("comp")).join(_broadcast(comps.select("comp", "rho")), "comp").groupBy("leaf").agg(F.max("rho").alias("radius"))
        now = scratch.table(fixed.join(reach, "leaf").join(state.select("leaf", "only"), "leaf"))
        pairs = _near(now, now)
        sides = tree.select("leaf", "xyz", "core").join(state.select("leaf", "comp"), "leaf")
        rows = pairs.join(sides.join(now.select("leaf", "radius"), "leaf").withColumnRenamed("leaf", "q"), "q").join(sides.select(F.col("leaf").alias("t"), *[F.col(c).alias("t" + c) for c in ("xyz", "core", "comp")]), "t")
        found = rows.select("q", "t", "radius", "xyz", "core", "comp", "txyz", "tcore", "tcomp").mapInArrow(_least, "comp long, w double, lc double, a long, b long, other long")
        best = found.groupBy("comp").agg(F.min(F.struct("w", "lc", "a", "b", "other")).alias("e"))
        judged = scratch.table(comps.join(best, "comp", "left").withColumn("sure", F.coalesce(F.col("e.w") <= F.col("rho"), F.lit(False))))
        sure = judged.filter("sure").select("comp", "e.*")
        new = scratch.table(sure.select("a", "b", F.col("w").alias("length")).distinct())
        edges = new if edges is None else edges.union(new)
        links = sure.select(F.col("comp").alias("a"), F.col("other").alias("b"))
        if is_small(links, FINISH):
            label = scratch.table(links.groupBy().applyInPandas(_linked, "id long, component long"))
            label = comps.select("comp").join(label, comps["comp"] == label["id"], "left").select("comp", F.coalesce("component", "comp").alias("new"))
        else:
            label = connected_components(comps.select(F.col("comp").alias("id")), links)
            label = label.select(F.col("id").alias("comp"), F.col("component").alias("new"))
        grown = judged.join(label, "comp")
        rho = F.when(F.max("sure"), F.min(F.when(F.col("sure"), F.col("e.w"))) * 2).otherwise(F.least(F.max("e.w"), F.max("rho") * 2))
        rho = F.when(F.sum("n") * 2 > F.max("whole"), F.lit(0.0)).otherwise(F.greatest(rho, F.max("tiny")))  # the others reach the largest one
        names = state.select("leaf", F.explode("comps").alias("comp")).join(_broadcast(label), "comp").groupBy("leaf").agg(F.collect_list(F.struct(F.col("comp").alias("old"), "new")).alias("names"))
        state = scratch.table(state.join(names, "leaf").select("leaf", "comp", "names").mapInArrow(_relabel, pack))
        comps = scratch.table(grown.groupBy(F.col("new").alias("comp")).agg(rho.alias("rho"), F.max("tiny").alias("tiny"), F.sum("n").alias("n"), F.max("whole").alias("whole")))
    raise RuntimeError(f"the tree isn't whole after {MAX_ROUNDS} rounds")


def _linked(pdf: pd.DataFrame) -> pd.DataFrame:
    """Ends of links (a, b) with the smallest id that they reach."""
    up: dict[int, int] = {}

    def top(c: int) -> int:
        while up.setdefault(c, c) != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    for a, b in zip(pdf.a, pdf.b, strict=True):
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return pd.DataFrame({"id": list(up), "component": [top(c) for c in up]}, dtype="int64")


def _singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            core = np.frombuffer(r["core"])
            yield pa.RecordBatch.from_pydict({"comp": (r["leaf"] << BITS) + np.arange(len(core)), "rho": core, "tiny": np.full(len(core), r["extent"] * 1e-6 + 1e-300), "n": np.ones(len(core), np.int64), "whole": np.full(len(core), r["whole"])})


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for leaf, n in zip(*[batch.column(c).to_pylist() for c in ("leaf", "n")], strict=True):
            own = (leaf << BITS) + np.arange(n)
            yield pa.RecordBatch.from_pydict({"leaf": [leaf], "comp": pa.array([own.tobytes()], pa.binary()), "comps": pa.array([own.tolist()], pa.list_(pa.int64())), "only": pa.array([int(own[0]) if n == 1 else None], pa.int64())})


def _finish(pdf: pd.DataFrame) -> pd.DataFrame:
    """The edges that are left, shortest first, in one task; rows of edges (c, d, length, a, b), open nodes (c, n, need) and settled ones (c, root)."""
    nodes = pdf[pdf.kind == 1]
    size, need = dict(zip(nodes.c, nodes.n, strict=True)), dict(zip(nodes.c, nodes.need, strict=True))
    root = dict(zip(pdf[pdf.kind == 2].c, pdf[pdf.kind == 2].root, strict=True))
    members, up = {c: [c] for c in size}, {c: c for c in size}
    came, between = [], []

    def top(c: int) -> int:
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    def settle(c: int, at: int, length: float) -> None:
        for x in members.pop(c):
            root[x] = at
            came.append((0, x, at, length))

    edges = pdf[pdf.kind == 0].sort_values(["length", "a", "b"])
    for c, d, length in zip(edges.c, edges.d, edges.length, strict=True):
        if c in root and d in root:
            between.append((1, root[c], root[d], length))
        elif c in root or d in root:
            settle(*(top(d), root[c]) if c in root else (top(c), root[d]), length)
        else:
            x, y = top(c), top(d)
            up[y] = x
            size[x] += size[y]
            members[x] += members.pop(y)
            if size[x] >= need[x]:
                settle(x, min(members[x]), length)
    return pd.DataFrame(came + between, columns=["kind", "c", "root", "length"])


def joining(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """When points come to a cluster, from a spanning forest: rows (p, root, beta) and the edges (root, other, length) between clusters.

    ``nodes`` are (p, need), ``edges`` (a, b, length).  A root is a component that
    reached ``need`` points; beta is the length at which a point did, or joined
    one.  Points whose component never does are left out.
    """
    key = F.struct("length", "a", "b").alias("e")
    open_ = scratch.table(edges.select(F.col("a").alias("c"), F.col("b").alias("d"), key))
    small = scratch.table(nodes.select(F.col("p").alias("c"), "need", F.lit(1).cast("long").alias("n")))
    members = small.select(F.col("c").alias("p"), "c")
    out = settled = merges = None
    for _ in range(MAX_ROUNDS):
        if is_small(open_, FINISH):
            no = lambda kind: F.lit(0).cast(kind)  # noqa: E731  (pandas would make fractions of columns with nulls)
            rows = open_.select(F.lit(0).alias("kind"), "c", "d", "e.*", no("long").alias("n"), no("long").alias("need"), no("long").alias("root"))
            rows = rows.union(small.select(F.lit(1), "c", no("long"), no("double"), no("long"), no("long"), "n", "need", no("long")))
            if settled is not None:
                ends = open_.select("c").union(open_.select("d")).distinct()
                rows = rows.union(settled.join(ends, "c", "left_semi").select(F.lit(2), "c", no("long"), no("double"), no("long"), no("long"), no("long"), no("long"), "root"))
            # Only open nodes with an edge matter; the others are whole clouds that are too small.
            done = scratch.table(rows.groupBy().applyInPandas(_finish, "kind int, c long, root long, length double"))
            last = members.join(done.filter("kind = 0").select("c", "root", "length"), "c").select("p", "root", F.col("length").alias("beta"))
            between = done.filter("kind = 1").select(F.col("c").alias("root"), F.col("root").alias("other"), "length")
            return last if out is None else out.union(last), between if merges is None else merges.union(between)
        half = open_.union(open_.select("d", "c", "e")).join(small.select("c"), "c", "left_semi")
        pick = scratch.table(half.groupBy("c").agg(F.min(F.struct("e", "d")).alias("m")).select("c", "m.e", "m.d"))
        back = pick.select(F.col("c").alias("d"), F.col("d").alias("c"), F.col("e").alias("e2"))
        both = pick.join(back, ["c", "d"]).filter("e = e2 and c < d").select("c", "d", "e")
        size = small.select(F.col("c").alias("d"), F.col("n").alias("m"))
        both = scratch.table(both.join(small, "c").join(size, "d").select("c", "d", "e", (F.col("n") + F.col("m")).alias("n"), "need"))
        big = both.filter("n >= need")
        now = big.select("c", F.col("e").alias("beta"), F.col("c").alias("root")).union(big.select("d", "e", "c"))
        if settled is not None:
            known = settled.select(F.col("c").alias("d"), "beta", "root")
            now = now.union(pick.join(known, "d").filter("beta < e").select("c", F.col("e").alias("beta"), "root"))
        now = scratch.table(now)
        merged = both.filter("n < need")
        settled = now if settled is None else scratch.table(settled.union(now))
        came = members.join(now, "c").select("p", "root", F.col("beta.length").alias("beta"))
        out = scratch.table(came) if out is None else out.union(scratch.table(came))
        names = scratch.table(merged.select(F.col("d").alias("old"), F.col("c").alias("new")))
        renamed = lambda df, c: df.join(names, df[c] == names["old"], "left").withColumn(c, F.coalesce("new", c)).drop("old", "new")
        members = scratch.table(renamed(members.join(now.select("c"), "c", "left_anti"), "c"))
        sizes = merged.select("c", F.col("n").alias("more"))
        small = small.join(now.select("c"), "c", "left_anti").join(names, small["c"] == names["old"], "left_anti")
        small = scratch.table(small.join(sizes, "c", "left").select("c", "need", F.coalesce("more", "n").alias("n")))
        used = both.select("e").union(now.select(F.col("beta").alias("e")))
        open_ = scratch.table(renamed(renamed(open_.join(used.distinct(), "e", "left_anti").select("c", "d", "e"), "c"), "d"))
        ends = open_.join(settled.select("c", F.col("root").alias("x")), "c", "left").join(settled.select(F.col("c").alias("d"), F.col("root").alias("y")), "d", "left")
        ends = scratch.table(ends)
        between = ends.filter("x is not null and y is not null").select(F.col("x").alias("root"), F.col("y").alias("other"), F.col("e.length").alias("length"))
        merges = scratch.table(between) if merges is None else merges.union(scratch.table(between))
        open_ = ends.filter("x is null or y is null").select("c", "d", "e")
    raise RuntimeError(f"components are open after {MAX_ROUNDS} rounds")


def cluster_tree(births: dict[int, float], merges: list[tuple[int, int, float]]) -> tuple[dict[int, list[int]], list[tuple[int | None, float, float]]]:
    """The clusters (parent, first and last length) of one cloud, and those that each root is in, inner ones first.

    Equal lengths count at once; a root that is born at the length at which it
    joins others is part of what comes of it and no cluster before.
    """
    up = {r: r for r in births}

    def top(r: int) -> int:
        while up[r] != r:
            up[r] = up[up[r]]
            r = up[r]
        return r

    clusters: list[list] = [[None, b, np.inf] for b in births.values()]
    first = dict(zip(births, range(len(births)), strict=True))
    now = dict(first)
    merges = sorted(merges, key=lambda m: m[2])
    i = 0
    while i < len(merges):
        length, groups = merges[i][2], {}
        touched = set()
        while i < len(merges) and merges[i][2] == length:
            a, b = top(merges[i][0]), top(merges[i][1])
            touched |= {a, b}
            up[b] = a
            i += 1
        for r in touched:
            groups.setdefault(top(r), []).append(r)
        for t, parts in groups.items():
            real = [p for p in parts if clusters[now[p]][1] < length]
            late = [p for p in parts if clusters[now[p]][1] >= length]
            if len(real) == 1:
                into = now[real[0]]
            else:
                into = len(clusters)
                clusters.append([None, length, np.inf])
                for p in real:
                    clusters[now[p]][0], clusters[now[p]][2] = into, length
            for p in late:  # only roots themselves: what joins becomes older than its length
                clusters[now[p]][0], clusters[now[p]][2] = into, clusters[now[p]][1]
            now[t] = into
    paths = {}
    for r, c in first.items():
        path = []
        while c is not None:
            if clusters[c][1] < clusters[c][2]:
                path.append(c)
            c = clusters[c][0]
        paths[r] = path
    return paths, [tuple(c) for c in clusters]


def chosen(clusters: list[tuple[int | None, float, float]], own: dict[int, tuple[int, float]], largest: int) -> set[int]:
    """The clusters more stable than those inside them, of at most ``largest`` points; never the whole.

    ``own`` has the points that came to a cluster while it was one: their number, and the sum of their densities 1 / length.
    """
    inside: dict[int | None, list[int]] = {}
    for c, (parent, start, end) in enumerate(clusters):
        if start < end:
            inside.setdefault(parent, []).append(c)
    count, best, picked = {}, {}, {}
    order = sorted((c for c, (_, s, e) in enumerate(clusters) if s < e), key=lambda c: (clusters[c][1], clusters[c][2]))
    for c in order:  # what is inside ends when this begins
        _, start, end = clusters[c]
        children = inside.get(c, [])
        n, w = own.get(c, (0, 0.0))
        initial = sum(count[x] for x in children)
        count[c] = n + initial
        sub, subs = sum(best[x] for x in children), [y for x in children for y in picked[x]]
        if end == np.inf:
            best[c], picked[c] = sub, subs
            continue
        stable = w + initial / max(start, 1e-12) - count[c] / max(end, 1e-12)
        best[c], picked[c] = (stable, [c]) if stable >= sub and count[c] <= largest else (sub, subs)
    return {y for c in inside.get(None, []) for y in picked[c]}


def find_clusters(points: DataFrame, cloud: str = "cloud_id", least: float = 1 / 200, most: float = 1 / 8, size: int = LEAF) -> DataFrame:
    """(cloud, idx, cluster) of each point, -1 for noise; smallest and largest cluster as parts of the cloud's points."""
    base = points.select(F.col(f"`{cloud}`").alias("g"), "idx", *[F.col(c).cast("double").alias(c) for c in XYZ])
    whole = F.lit(True)
    for c in XYZ:
        whole = whole & F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))
    good = base.filter(whole)
    count = materialise(good.groupBy("g").agg(F.count("*").alias("whole")))
    tree = core_distances(leaves(good, least, size))
    nodes = materialise(tree.select("g", "k", "leaf", F.posexplode("ids").alias("i", "idx")).select("g", (F.shiftleft("leaf", BITS) + F.col("i")).alias("p"), "idx", F.col("k").alias("need")))
    scratch = Scratch(base.sparkSession)
    came, merges = joining(nodes.select("p", "need"), spanning_tree(tree, scratch), scratch)
    out = [F.col("g").alias(cloud), "idx", F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster")]
    came, merges = scratch.table(came), scratch.table(merges)
    of = nodes.select(F.col("p").alias("root"), "g")
    births = came.groupBy("root").agg(F.min("beta").alias("length")).join(of, "root").select("g", "root", F.lit(None).cast("long").alias("other"), "length")
    frame = births.union(merges.join(of, "root").select("g", "root", "other", "length"))
    g = F.struct("g")  # null is a cloud too
    frame = materialise(frame)

    def paths(pdf: pd.DataFrame) -> pd.DataFrame:
        path, clusters, _ = _treed(pdf)
        rows = [(r, c, clusters[c][1], clusters[c][2]) for r, cs in path.items() for c in cs]
        return pd.DataFrame(rows, columns=["root", "cluster", "start", "end"])

    on = frame.groupBy(g).applyInPandas(paths, "root long, cluster long, start double, end double")
    ways = materialise(on.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("start", "end", "cluster"))).alias("way")))
    joined = came.join(_broadcast(ways), "root").withColumn("at", F.get(F.filter("way", lambda w: w["end"] > F.col("beta")), F.lit(0)))
    weigh = joined.join(_broadcast(of.join(ways.select("root"), "root", "left_semi")), "root").groupBy("g", F.col("at.cluster").alias("root")).agg(F.count("*").alias("other"), F.sum(1 / F.greatest("beta", F.lit(1e-12))).alias("length"))
    sums = frame.withColumn("kind", F.lit(0)).union(weigh.select("g", "root", "other", "length", F.lit(1)))
    sizes = materialise(count.select("g", F.greatest(F.lit(2), F.floor(F.col("whole") * most)).cast("long").alias("root"), F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(2)))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        if not (pdf.kind == 0).any():
            return pd.DataFrame({"root": [], "cluster": [], "end": []}).astype({"root": "int64", "cluster": "int64"})
        path, clusters, _ = _treed(pdf[pdf.kind == 0])
        own = {int(r.root): (int(r.other), r.length) for r in pdf[pdf.kind == 1].itertuples()}
        good = chosen(clusters, own, int(pdf[pdf.kind == 2].root.iloc[0]))
        rows = [(r, c, clusters[c][2]) for r, cs in path.items() for c in cs if c in good]
        return pd.DataFrame(rows, columns=["root", "cluster", "end"])

    picked = materialise(sums.union(sizes).groupBy(g).applyInPandas(choose, "root long, cluster long, end double"))
    named = came.join(_broadcast(picked), "root").filter("beta < end").select("p", "cluster").join(nodes.select("p", "g", "idx"), "p")
    named = materialise(named)
    numbers = named.groupBy("g", "cluster").agg(F.min("idx").alias("least")).select(F.col("g").alias("_g"), F.col("cluster").alias("_c"), (F.row_number().over(Window.partitionBy("g").orderBy("least")) - 1).alias("number"))
    numbers = materialise(numbers)
    scratch.clear()
    labels = named.join(_broadcast(numbers), F.col("g").eqNullSafe(F.col("_g")) & (F.col("cluster") == F.col("_c"))).select("p", F.col("number").alias("cluster"))
    known = nodes.join(labels, "p", "left").select(*out)
    noise = base.filter(~whole).select(F.col("g").alias(cloud), "idx", F.lit(-1).alias("cluster"))
    few = good.join(_broadcast(nodes.select(F.col("g").alias("_g")).distinct()), F.col("g").eqNullSafe(F.col("_g")), "left_anti").select(F.col("g").alias(cloud), "idx", F.lit(-1).alias("cluster"))
    return known.union(noise).union(few)


def _treed(pdf: pd.DataFrame):
    births = pdf[pdf.other.isna()]
    joins = pdf[pdf.other.notna()]
    order = births.sort_values("root")
    merges = [(int(a), int(b), d) for a, b, d in sorted(zip(joins.root, joins.other, joins.length, strict=True), key=lambda m: (m[2], m[0], m[1]))]
    path, clusters = cluster_tree({int(r): b for r, b in zip(order.root, order.length, strict=True)}, merges)
    return path, clusters, births
