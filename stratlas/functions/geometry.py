"""Points, boxes, affine maps and planes as column expressions; coordinates in millimetres unless said otherwise."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = Sequence[Sequence[float]]


def affine_scaling(m: Matrix) -> float:
    """Volume of a voxel: the product of the column norms of the upper 3x3 part."""
    return math.prod(math.sqrt(sum(m[i][j] ** 2 for i in range(3))) for j in range(3))


def translation(v: Sequence[float]) -> list[list[float]]:
    return [[1.0, 0, 0, v[0]], [0, 1.0, 0, v[1]], [0, 0, 1.0, v[2]], [0, 0, 0, 1.0]]


def rotation_y(alpha: float) -> list[list[float]]:
    c, s = math.cos(alpha), math.sin(alpha)
    return [[c, 0, s, 0], [0, 1.0, 0, 0], [-s, 0, c, 0], [0, 0, 0, 1.0]]


def compose(a: Matrix, b: Matrix) -> list[list[float]]:
    return [[sum(a[i][k] * b[k][j] for k in range(4)) for j in range(4)] for i in range(4)]


def inverse(m: Matrix) -> list[list[float]]:
    """Inverse of an affine matrix whose last row is 0 0 0 1."""
    a, b, c, d, e, f, g, h, i = (m[r][k] for r in range(3) for k in range(3))
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    if not det:
        raise ValueError("the matrix has no inverse")
    inv = [[(e * i - f * h), (c * h - b * i), (b * f - c * e)], [(f * g - d * i), (a * i - c * g), (c * d - a * f)], [(d * h - e * g), (b * g - a * h), (a * e - b * d)]]
    inv = [[x / det for x in row] for row in inv]
    return [[*row, -sum(row[k] * m[k][3] for k in range(3))] for row in inv] + [[0.0, 0.0, 0.0, 1.0]]


def shift_half_voxel(m: Matrix) -> list[list[float]]:
    """An affine for voxel centres from one for voxel corners."""
    return compose(m, translation((0.5, 0.5, 0.5)))


def transform(m: Matrix, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A homogeneous transform with constant matrix, divided by its last coordinate if that isn't 1."""
    row = lambda r: m[r][0] * x + m[r][1] * y + m[r][2] * z + m[r][3]
    if list(m[3]) == [0, 0, 0, 1]:
        return row(0), row(1), row(2)
    return row(0) / row(3), row(1) / row(3), row(2) / row(3)


def transform_by(m: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """The transform whose 3x4 or 4x4 matrix is a row-major array column."""
    row = lambda r: F.get(m, F.lit(4 * r)) * x + F.get(m, F.lit(4 * r + 1)) * y + F.get(m, F.lit(4 * r + 2)) * z + F.get(m, F.lit(4 * r + 3))
    return row(0), row(1), row(2)


def section_number(y: Column) -> Column:
    """Index of the 20 micron section at a y coordinate."""
    return ((y + 70) / 0.02 + 1.5).cast("int")


def sphere_volume(sigma: Column) -> Column:
    return F.pow(sigma, 3) * math.pi * 4 / 3


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a, b, strict=True)), F.lit(0.0)))


def box_volume(low: Sequence[Column], high: Sequence[Column], s0: Column, s1: Column) -> Column:
    """Volume of a box; a side without extent counts the corners' uncertainty."""
    out = F.lit(1.0)
    for a, b in zip(low, high, strict=True):
        out = out * F.when(b - a > 0, b - a).otherwise(s0 + s1)
    return out


def interval_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Two intervals share more than an end."""
    return F.greatest(a0, b0) < F.least(a1, b1)


def sidedness(normal: Sequence[float], d: float, x: Column, y: Column, z: Column) -> Column:
    """1 on the side that the plane's normal shows to, and on the plane."""
    return (normal[0] * x + normal[1] * y + normal[2] * z >= d).cast("int")


def project(normal: Sequence[float], d: float, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """The point's foot on a plane with unit normal."""
    away = normal[0] * x + normal[1] * y + normal[2] * z - d
    return x - away * normal[0], y - away * normal[1], z - away * normal[2]


def segment_hit(normal: Sequence[float], d: float, a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Where a segment meets a plane: struct x, y, z; null if it doesn't, or runs in the plane."""
    dot = lambda p: normal[0] * p[0] + normal[1] * p[1] + normal[2] * p[2]
    run = dot(b) - dot(a)
    t = F.when(run != 0, (F.lit(d) - dot(a)) / run)
    return F.when((t >= 0) & (t <= 1), F.struct(*[(p + t * (q - p)).alias(c) for c, p, q in zip("xyz", a, b, strict=True)]))


def plane_through(p: Sequence[Sequence[float]]) -> tuple[tuple[float, float, float], float]:
    """Unit normal and distance from the origin of the plane through three points."""
    u, v = ([p[k][i] - p[0][i] for i in range(3)] for k in (1, 2))
    n = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    size = math.sqrt(sum(x * x for x in n))
    if not size:
        raise ValueError("the points are on one line")
    n = tuple(x / size for x in n)
    return n, sum(n[i] * p[0][i] for i in range(3))


def gaussian_kernel(sigma: float, reach: float = 3) -> list[tuple[int, int, int, float]]:
    """Offsets and weights (sum 1) of a cubic kernel of radius ``int(reach * sigma)``."""
    r = int(reach * sigma)
    line = {i: math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)}
    whole = sum(line.values()) ** 3
    return [(i, j, k, line[i] * line[j] * line[k] / whole) for i in line for j in line for k in line]


def gaussian_line(sigma: float, reach: float = 3) -> tuple[int, float]:
    """Radius ``int(reach * sigma)`` of a kernel along one axis, and what its values sum to."""
    r = int(reach * sigma)
    return r, sum(math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1))


def estimate_affine(pairs: Sequence[tuple[Sequence[float], Sequence[float]]]) -> list[list[float]]:
    """Least-squares affine that maps the first points of the pairs to the second ones."""
    import numpy as np

    a = np.array([[*p, 1.0] for p, _ in pairs])
    got, *_ = np.linalg.lstsq(a, np.array([q for _, q in pairs], dtype=float), rcond=None)
    return [*got.T.tolist(), [0.0, 0.0, 0.0, 1.0]]
