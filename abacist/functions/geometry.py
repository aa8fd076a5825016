"""Box geometry as column expressions. A box is four columns (or values) ``x1, y1, x2, y2``."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box(prefix: str = "") -> Box:
    return Box(*[F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")])


def box_of(xyxy: Column) -> Box:
    """From an array of four numbers."""
    return Box(*[xyxy[i] for i in range(4)])


def center(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2


def area(b: Box) -> Column:
    return F.greatest(b.x2 - b.x1, F.lit(0.0)) * F.greatest(b.y2 - b.y1, F.lit(0.0))


def overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Length that two intervals share, at least 0."""
    return F.greatest(F.least(a2, b2) - F.greatest(a1, b1), F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union has no area."""
    shared = overlap(a.x1, a.x2, b.x1, b.x2) * overlap(a.y1, a.y2, b.y1, b.y2)
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def intersects(a: Box, b: Box) -> Column:
    """Touching boxes intersect."""
    return (a.x1 <= b.x2) & (b.x1 <= a.x2) & (a.y1 <= b.y2) & (b.y1 <= a.y2)


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]))


def valid_box(xyxy: Column) -> Column:
    """At least four numbers, the first four finite."""
    finite = F.forall(F.slice(xyxy, 1, 4), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(xyxy) >= 4) & finite, F.lit(False))


def line_direction(b: Box, tolerance: float = 5.0) -> Column:
    """``horizontal``, ``vertical`` or ``diagonal``, by the angle in degrees."""
    angle = F.abs(F.degrees(F.atan2(b.y2 - b.y1, b.x2 - b.x1)))
    flat = (angle <= tolerance) | (angle >= 180 - tolerance)
    return F.when(flat, "horizontal").when(F.abs(angle - 90) <= tolerance, "vertical").otherwise("diagonal")
