"""Vector and hyperbolic geometry over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return norm(d)


def scaled(a: Column, f: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * f)


def to_ball(a: Column) -> Column:
    """Points outside the open unit ball are drawn to just inside it."""
    n = norm(a)
    return F.when(n < 1 - EPS, F.transform(a, lambda x: x.cast("double"))).otherwise(scaled(a, (1 - EPS) / n))


def poincare_distance(u: Column, v: Column) -> Column:
    """arcosh(1 + 2 |u - v|^2 / ((1 - |u|^2)(1 - |v|^2))) of points inside the ball."""
    d = distance(u, v)
    return F.acosh(1 + 2 * d * d / ((1 - dot(u, u)) * (1 - dot(v, v))))


def poincare_radius(u: Column) -> Column:
    return 2 * F.atanh(F.least(norm(u), F.lit(1 - EPS)))


def minkowski(a: Column, b: Column) -> Column:
    """Lorentz product: minus the time parts (first), plus the rest."""
    return dot(a, b) - 2 * F.element_at(a, 1).cast("double") * F.element_at(b, 1).cast("double")


def exp0(v: Column) -> Column:
    """Exponential map at the origin of the unit hyperboloid."""
    n = F.greatest(norm(v), F.lit(1e-12))
    return F.concat(F.array(F.cosh(n)), scaled(v, F.sinh(n) / n))


def log0(x: Column) -> Column:
    space = F.slice(x, 2, F.size(x) - 1)
    n = F.greatest(norm(space), F.lit(1e-12))
    return scaled(space, F.acosh(F.greatest(F.element_at(x, 1), F.lit(1.0))) / n)


def lorentz_distance(a: Column, b: Column) -> Column:
    return F.acosh(F.greatest(-minkowski(a, b), F.lit(1.0)))


def to_poincare(x: Column) -> Column:
    return scaled(F.slice(x, 2, F.size(x) - 1), 1 / (1 + F.element_at(x, 1)))
