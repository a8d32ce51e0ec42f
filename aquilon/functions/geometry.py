"""Scalar geometry as column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MASS_H, MASS_O

AXES = ("x", "y", "z")


def _c(x) -> Column:
    return F.lit(float(x)) if isinstance(x, (int, float)) else x


def image(d: Column, box=1.0) -> Column:
    """The difference folded once into [-L/2, L/2)."""
    box = _c(box)
    return F.when(d >= box / 2, d - box).when(d < -box / 2, d + box).otherwise(d)


def norm2(v) -> Column:
    return reduce(lambda a, b: a + b, [x * x for x in v])


def norm(v) -> Column:
    return F.sqrt(norm2(v))


def dot(a, b) -> Column:
    return reduce(lambda p, q: p + q, [x * y for x, y in zip(a, b)])


def cross(a, b) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def minus(a, b) -> list[Column]:
    return [x - y for x, y in zip(a, b)]


def axes(prefix: str = "", suffix: str = "", of=AXES) -> list[Column]:
    return [F.col(f"{prefix}{k}{suffix}") for k in of]


def distance(a, b, box=None, mode: str = "normal") -> Column:
    """mode normal: Euclidean; pbc: with each difference folded into the box (default edge 1)."""
    if mode == "normal":
        return norm(minus(a, b))
    if mode != "pbc":
        raise ValueError(f"unknown mode {mode!r}: normal or pbc")
    return norm([image(d, e) for d, e in zip(minus(a, b), box or (1.0, 1.0, 1.0))])


def wrap_once(v: Column, box=1.0) -> Column:
    """v - L where v >= L, then v + L where v < 0; one image only."""
    box = _c(box)
    return F.when(v >= box, v - box).when(v < 0, v + box).otherwise(v)


def wrap_open(v: Column, box=1.0) -> Column:
    """As wrap_once, but v = L stays."""
    box = _c(box)
    return F.when(v > box, v - box).when(v < 0, v + box).otherwise(v)


def sphere_volume(r: Column) -> Column:
    return F.lit(4.0) * F.pi() * F.pow(r, F.lit(3.0)) / F.lit(3.0)


def circular_com(parts) -> Column:
    """Mass-weighted mean of scaled coordinates on a circle; parts: (mass, coordinate) pairs."""
    total = sum(m for m, _ in parts)
    turn = F.lit(2 * math.pi)
    xi = reduce(lambda a, b: a + b, [F.lit(m) * F.cos(turn * c) for m, c in parts]) / total
    zeta = reduce(lambda a, b: a + b, [F.lit(m) * F.sin(turn * c) for m, c in parts]) / total
    return (F.atan2(-zeta, -xi) + F.pi()) / turn


def water_com(h1, h2, o) -> list[Column]:
    return [circular_com([(MASS_H, a), (MASS_H, b), (MASS_O, c)]) for a, b, c in zip(h1, h2, o)]


def p_vector(h1, h2, com, shifted: bool = True) -> list[Column]:
    """Unit vector from the centre of mass to the midpoint of both hydrogens, in scaled coordinates, with the
    first hydrogen moved to the middle of the box. shifted=False keeps the centre of mass unmoved."""
    move = [F.lit(0.5) - c for c in h1]
    a, b, c = ([wrap_open(q + m) for q, m in zip(v, move)] for v in (h1, h2, com))
    p = [(i + j) / 2 - k for i, j, k in zip(a, b, c if shifted else com)]
    n = norm(p)
    return [F.try_divide(q, n) for q in p]


def delta_phi(p, q, clip: bool = True) -> list[Column]:
    """The turn from p to q: arccos(p.q) along p x q; clip: cosines are held in [-1, 1] and no axis means no turn, else NaN."""
    c, v = dot(p, q), cross(p, q)
    if not clip:
        n = norm(v)
        return [F.when(n == 0, F.lit(float("nan"))).otherwise(F.acos(c) * F.try_divide(x, n)) for x in v]
    n = norm(v)
    angle = F.acos(F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0)))
    return [F.when(n == 0, F.lit(0.0)).otherwise(angle * F.try_divide(x, n)) for x in v]


def displaced_hydrogen(h1, h2, o) -> list[Column]:
    """The midpoint of both hydrogens mirrored at the oxygen, then moved out in steps of 0.05 of that vector
    until it is 1.1 times as far as the nearer hydrogen."""
    v = [(a + b) / 2 - c for a, b, c in zip(h1, h2, o)]
    near = F.least(distance(h1, o, mode="pbc"), distance(h2, o, mode="pbc"))
    k = F.when(norm(v) > 0, F.greatest(F.lit(0.0), F.ceil((F.try_divide(1.1 * near, norm(v)) - 1) / 0.05 - 1e-9).cast("double"))).otherwise(F.lit(0.0))
    return [c - (1 + 0.05 * k) * x for c, x in zip(o, v)]
