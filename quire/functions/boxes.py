"""Boxes as structs of x, y, w, h in page units (0 to 1), and pixel or point edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST = 1e-6


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), F.lit("page_norm").alias("coord_space"))


FULL_PAGE = lambda: box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))


def from_edges(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Page box of pixel or point edges: start and extent clamped, extent at least LEAST."""
    extent = lambda a, b, size: F.greatest(clamp01(F.greatest(F.lit(0.0), b - a) / size), F.lit(LEAST))
    return box(clamp01(x0 / width), clamp01(y0 / height), extent(x0, x1, width), extent(y0, y1, height))


def from_corners(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Page box between corners in page units, each clamped."""
    left, top = clamp01(left), clamp01(top)
    span = lambda a, b: F.greatest(F.lit(LEAST), clamp01(b) - a)
    return box(left, top, span(left, right), span(top, bottom))


def padded(b: Column, pad_x: float = 0.006, pad_y: float = 0.004) -> Column:
    return from_corners(b.x - pad_x, b.y - pad_y, b.x + b.w + pad_x, b.y + b.h + pad_y)


def overlap_area(a: Column, b: Column) -> Column:
    """Area that two boxes share; 0 where they don't meet."""
    w = F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x)
    h = F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y)
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b.w * b.h)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where it isn't defined."""
    inter = overlap_area(a, b)
    union = area(a) + area(b) - inter
    return F.when(inter > 0, inter / union).otherwise(0.0)


def column_hint(b: Column) -> Column:
    """1 for boxes centred right of .62, else 0."""
    return F.when(b.x + b.w / 2 > 0.62, 1).otherwise(0)


def edge_iou(a: Column, b: Column) -> Column:
    """IoU of structs of x1, y1, x2, y2."""
    w = F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.lit(0))
    h = F.greatest(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1), F.lit(0))
    size = lambda r: F.greatest(r.x2 - r.x1, F.lit(0)) * F.greatest(r.y2 - r.y1, F.lit(0))
    union = size(a) + size(b) - w * h
    return F.when(union > 0, (w * h) / union).otherwise(0.0)


def set_iou(left: Column, right: Column) -> Column:
    """Best IoU between two arrays of edge boxes: 1 if both are empty, 0 if one is."""
    best = F.array_max(F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: edge_iou(a, b)))))
    none = lambda x: F.coalesce(F.size(x), F.lit(0)) <= 0
    return F.when(none(left) & none(right), 1.0).when(none(left) | none(right), 0.0).otherwise(best)


def detector_box(
    left: Column, top: Column, right: Column, bottom: Column, image_w: Column, image_h: Column
) -> Column:
    """Page box of a detector's edges: in page units already if none is over 1.5, else pixels.

    Null for boxes without extent after clamping.
    """
    small = F.greatest(left, top, right, bottom) <= 1.5
    scale = lambda v, size: clamp01(F.when(small, v).otherwise(v / size))
    x1, y1, x2, y2 = scale(left, image_w), scale(top, image_h), scale(right, image_w), scale(bottom, image_h)
    return F.when((x2 > x1) & (y2 > y1), box(x1, y1, x2 - x1, y2 - y1))
