"""Three-component vectors as tuples of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str, names: str = "xyz", suffix: str = "") -> Vec:
    return tuple(F.col(f"{prefix}{n}{suffix}") for n in names)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def floored_norm(a: Vec) -> Column:
    """Norm of at least 1e-15, to divide by."""
    return F.greatest(norm(a), F.lit(1e-15))


def scaled(a: Vec, by: Column) -> Vec:
    return a[0] / by, a[1] / by, a[2] / by


def clipped(x: Column, low: float, high: float) -> Column:
    """x held in [low, high]; NaN stays NaN, as greatest() would not have it."""
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))
