"""Cell and vector arithmetic as columns: everything stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]

#: Names of the lattice columns, row by row.
LATTICE = ["ax", "ay", "az", "bx", "by", "bz", "cx", "cy", "cz"]


def lattice(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> list[Column]:
    """Nine columns of the lattice: a along x, b in the xy plane."""
    al, be, ga = F.radians(alpha), F.radians(beta), F.radians(gamma)
    zero = F.lit(0.0)
    cx = c * F.cos(be)
    cy = c * (F.cos(al) - F.cos(be) * F.cos(ga)) / F.sin(ga)
    cz = F.sqrt(F.greatest(c * c - cx * cx - cy * cy, zero))
    return [a, zero, zero, b * F.cos(ga), b * F.sin(ga), zero, cx, cy, cz]


def to_cartesian(f: Vector, names: list[str] = LATTICE) -> Vector:
    m = [F.col(n) for n in names]
    return tuple(f[0] * m[k] + f[1] * m[3 + k] + f[2] * m[6 + k] for k in range(3))


def determinant(names: list[str] = LATTICE) -> Column:
    a, b, c, d, e, f, g, h, i = (F.col(n) for n in names)
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def to_fractional(x: Vector, names: list[str] = LATTICE) -> Vector:
    """By the closed inverse of the lattice."""
    a, b, c, d, e, f, g, h, i = (F.col(n) for n in names)
    det = determinant(names)
    inverse = [[e * i - f * h, c * h - b * i, b * f - c * e], [f * g - d * i, a * i - c * g, c * d - a * f], [d * h - e * g, b * g - a * h, a * e - b * d]]
    return tuple((x[0] * inverse[0][k] + x[1] * inverse[1][k] + x[2] * inverse[2][k]) / det for k in range(3))


def canonical(v: Column, decimals: int = 8) -> Column:
    """Wrapped into [0, 1), almost 1 as 0, rounded."""
    w = v - F.floor(v)
    return F.bround(F.when(F.abs(w - 1) <= 10.0**-decimals, 0.0).otherwise(w), decimals)


def norm(v: Vector) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def minus(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def nearest_image(f: Vector, g: Vector) -> Column:
    """Distance of two fractional points by the nearest image of their difference."""
    d = tuple(y - x - F.rint(y - x) for x, y in zip(f, g))
    return norm(to_cartesian(d))


def angle(i: Vector, j: Vector, k: Vector) -> Column:
    """Degrees at j; NaN where two points coincide, null for a missing point."""
    u, v = minus(i, j), minus(k, j)
    size = norm(u) * norm(v)
    value = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(u, v), size)))))
    # greatest and least pass over nulls, so a missing point needs its own branch
    return F.when(size < 1e-12, F.lit(float("nan"))).when(size >= 1e-12, value)


def dihedral(i: Vector, j: Vector, k: Vector, m: Vector) -> Column:
    """Signed degrees about j-k; NaN for points in line."""
    b0, b1, b2 = minus(i, j), minus(k, j), minus(m, k)
    length = norm(b1)
    axis = tuple(F.try_divide(x, length) for x in b1)
    v = minus(b0, tuple(dot(b0, axis) * x for x in axis))
    w = minus(b2, tuple(dot(b2, axis) * x for x in axis))
    value = F.degrees(F.atan2(dot(cross(axis, v), w), dot(v, w)))
    return F.when((length < 1e-12) | (norm(v) < 1e-12) | (norm(w) < 1e-12), F.lit(float("nan"))).otherwise(value)


def linear_margin(degrees: Column) -> Column:
    """How far an angle is from a straight line; -1 for NaN."""
    return F.when(F.isnan(degrees), -1.0).otherwise(F.least(F.abs(degrees), F.abs(F.lit(180.0) - degrees)))


def wrapped_difference(degrees: Column) -> Column:
    """Into [-180, 180)."""
    v = degrees + 180.0
    return v - F.floor(v / 360.0) * 360.0 - 180.0


def reciprocal() -> list[Vector]:
    """Reciprocal vectors of the lattice columns, with the factor 2 pi."""
    m = [F.col(n) for n in LATTICE]
    a, b, c = tuple(m[:3]), tuple(m[3:6]), tuple(m[6:])
    volume = dot(a, cross(b, c))
    two_pi = F.lit(2.0) * F.pi()
    return [tuple(two_pi * x / volume for x in cross(p, q)) for p, q in ((b, c), (c, a), (a, b))]


def bond_scale(e1: Column, e2: Column, scale: float = 1.2, hydrogen: float = 1.3) -> Column:
    return F.when((e1 == "H") | (e2 == "H"), F.lit(max(scale, hydrogen))).otherwise(F.lit(scale))
