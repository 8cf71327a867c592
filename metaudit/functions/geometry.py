"""Column functions on numbers in text, slice geometry and tolerances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tolerances of the checks.
ORIENTATION_TOLERANCE = 1e-4
POSITION_TOLERANCE = 0.01
SPACING_TOLERANCE = 1e-4
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def number(text: Column) -> Column:
    """A decimal number, or null for anything else (also for an empty text)."""
    return F.when(F.rlike(text, F.lit(_NUMBER)), F.trim(text).try_cast("double"))


def numbers(text: Column, count: int) -> Column:
    """``count`` numbers joined with backslashes, or null if there are not exactly so many readable ones."""
    parsed = F.transform(F.split(text, r"\\"), number)
    return F.when((F.size(parsed) == count) & ~F.exists(parsed, lambda x: x.isNull() | F.isnan(x)), parsed)


def _at(a: Column, k: int) -> Column:
    return F.get(a, F.lit(k))


def slice_normal(orientation: Column) -> Column:
    """Unit normal of the plane of row and column cosines; null if they are parallel or zero."""
    r, c = [_at(orientation, k) for k in range(3)], [_at(orientation, k) for k in range(3, 6)]
    cross = [r[1] * c[2] - r[2] * c[1], r[2] * c[0] - r[0] * c[2], r[0] * c[1] - r[1] * c[0]]
    length = F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2])
    return F.when(length > 0, F.array(*[F.try_divide(x, length) for x in cross]))


def project(position: Column, normal: Column) -> Column:
    """How far a point lies along a unit normal."""
    return _at(position, 0) * _at(normal, 0) + _at(position, 1) * _at(normal, 1) + _at(position, 2) * _at(normal, 2)


def orientations_agree(a: Column, b: Column) -> Column:
    """All six components within the tolerance, inclusive."""
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d <= ORIENTATION_TOLERANCE)
