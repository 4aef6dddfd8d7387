"""Axis-aligned boxes: structs or column tuples (x, y, w, h)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import half_up

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", suffix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}{suffix}") for c in "xywh")


def overlap(a: Box, b: Box) -> Column:
    """Area that two boxes share."""
    w = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Box, b: Box) -> Column:
    """Shared area over joint area; 0 when the joint area isn't positive."""
    both = overlap(a, b)
    union = a[2] * a[3] + b[2] * b[3] - both
    return F.when(union <= 0, 0.0).otherwise(both / F.when(union <= 0, 1.0).otherwise(union))


def coverage(a: Box, b: Box) -> Column:
    """Share of box a that box b covers."""
    area = a[2] * a[3]
    return F.when(area > 0, overlap(a, b) / F.when(area > 0, area).otherwise(1.0)).otherwise(0.0)


def same_line(a: Box, b: Box) -> Column:
    """Overlap of over 0.7 of the narrower width and over half the lower height."""
    x = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    y = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return (x > 0.7 * F.least(a[2], b[2])) & (y > 0.5 * F.least(a[3], b[3]))


def padded(a: Box, p, width, height) -> Box:
    """Grown by p on every side, clipped to the canvas."""
    x, y = F.greatest(F.lit(0.0), a[0] - p), F.greatest(F.lit(0.0), a[1] - p)
    return x, y, F.least(F.lit(float(width)), a[0] + a[2] + p) - x, F.least(F.lit(float(height)), a[1] + a[3] + p) - y


def scaled(a: Box, s) -> Box:
    return tuple(c * s for c in a)


def rounded(a: Box) -> Box:
    return tuple(half_up(c) for c in a)


def denormalised(a: Box, width, height) -> Box:
    """A box in shares of the canvas (0 to 1) as whole pixels."""
    return half_up(a[0] * width), half_up(a[1] * height), half_up(a[2] * width), half_up(a[3] * height)


def contains(outer: Box, inner: Box) -> Column:
    """inner lies strictly inside outer."""
    return (inner[0] > outer[0]) & (inner[1] > outer[1]) & (inner[0] + inner[2] < outer[0] + outer[2]) & (inner[1] + inner[3] < outer[1] + outer[3])
