"""Density clusters of one small array (clouds of any size: ``density``), and the oriented patch around points."""

from __future__ import annotations

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def _tree(points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum spanning tree of mutual reachability distances: edges and their lengths, shortest first."""
    n = len(points)
    core = np.empty(n)
    for i in range(n):
        d = np.sqrt(((points - points[i]) ** 2).sum(1))
        core[i] = np.partition(d, min(k, n - 1))[min(k, n - 1)]
    best, source, free = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    edges, lengths, at = [], [], 0
    for _ in range(n - 1):
        free[at] = False
        d = np.maximum(np.maximum(np.sqrt(((points - points[at]) ** 2).sum(1)), core[at]), core)
        closer = free & (d < best)
        best[closer], source[closer] = d[closer], at
        at = int(np.where(free, best, np.inf).argmin())
        edges.append((source[at], at))
        lengths.append(best[at])
    order = np.argsort(lengths, kind="stable")
    return np.array(edges).reshape(-1, 2)[order], np.array(lengths)[order]


def density_clusters(points: np.ndarray, smallest: int, largest: int) -> np.ndarray:
    """Hierarchical density clusters of one small array: labels from 0 by first point, -1 for noise.

    Components of the tree grow as longer edges join them, edges of one length at
    once; one of at least ``smallest`` points is a cluster, which lives until it
    joins another such.  Its stability is the sum over its points of 1/length from
    when a point came to when the cluster ends; the clusters chosen are those more
    stable than all that are inside them together, and of at most ``largest``
    points.  The whole is none.
    """
    n = len(points)
    labels = np.full(n, -1)
    if n < max(2, smallest):
        return labels
    edges, lengths = _tree(points, smallest)
    up = list(range(n))
    members = {i: [i] for i in range(n)}
    #: Of components that are clusters: the sum of their points' joining densities, and (stability, clusters) chosen inside.
    weight: dict[int, float] = {}
    inside: dict[int, tuple[float, list[list[int]]]] = {}

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    at = 0
    while at < n - 1:
        length, density, touched = lengths[at], 1 / max(lengths[at], 1e-12), set()
        while at < n - 1 and lengths[at] == length:
            a, b = (root(i) for i in edges[at].tolist())
            touched |= {a, b}
            up[b] = a
            at += 1
        groups: dict[int, list[int]] = {}
        for r in touched:
            groups.setdefault(root(r), []).append(r)
        for top, parts in groups.items():
            here = {r: members.pop(r) for r in parts}
            old, every = [r for r in parts if r in weight], [i for r in parts for i in here[r]]
            if len(old) == 1:
                weight[top], inside[top] = weight.pop(old[0]) + (len(every) - len(here[old[0]])) * density, inside.pop(old[0])
            elif len(every) >= smallest:
                chosen: tuple[float, list[list[int]]] = (0.0, [])
                for r in old:
                    own, sub = weight.pop(r) - len(here[r]) * density, inside.pop(r)
                    best = (own, [here[r]]) if own >= sub[0] and len(here[r]) <= largest else sub
                    chosen = (chosen[0] + best[0], chosen[1] + best[1])
                weight[top], inside[top] = len(every) * density, chosen
            members[top] = every
    for c, part in enumerate(sorted(inside.get(root(0), (0.0, []))[1], key=min)):
        labels[part] = c
    return labels


def enclosing_patch(points: DataFrame) -> tuple[list[float], list[list[float]], list[float], list[float]]:
    """Mean, axes (most spread first) and extents along them of a cloud: moments and extents are two aggregations."""
    c = ("x", "y", "z")
    m = points.agg(*[F.avg(v).alias(v) for v in c], *[F.covar_pop(a, b).alias(a + b) for a in c for b in c]).first()
    mean = [m[v] for v in c]
    values, vectors = np.linalg.eigh(np.array([[m[a + b] for b in c] for a in c]))
    axes = vectors[:, np.argsort(-values)].T.tolist()
    along = [sum((F.col(v) - mean[i]) * a[i] for i, v in enumerate(c)) for a in axes]
    e = points.agg(*[F.min(x) for x in along], *[F.max(x) for x in along]).first()
    return mean, axes, list(e[:3]), list(e[3:])
