"""Rectangle arithmetic on columns x0, y0, x1, y1 (points, origin top left)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def rect(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{s}") for s in SIDES)


def area(r) -> Column:
    return F.greatest(F.lit(0.0), r[2] - r[0]) * F.greatest(F.lit(0.0), r[3] - r[1])


def overlap(a, b) -> Column:
    """Area of the intersection; 0 where there is none, as of a rectangle with a null side."""
    both = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    # least and greatest pass over nulls, a sum does not
    return F.when(sum([*a[1:], *b], a[0]).isNull(), 0.0).otherwise(both)


def share_inside(a, b) -> Column:
    """The share of ``a`` that lies in ``b``; 0 of an empty ``a``."""
    return F.coalesce(F.try_divide(overlap(a, b), area(a)), F.lit(0.0))


def centre_inside(a, b) -> Column:
    cx, cy = (a[0] + a[2]) / 2, (a[1] + a[3]) / 2
    return cx.between(b[0], b[2]) & cy.between(b[1], b[3])


def aspect(r) -> Column:
    """Longer over shorter side; null without a shorter side."""
    w, h = r[2] - r[0], r[3] - r[1]
    return F.try_divide(F.greatest(w, h), F.least(w, h))
