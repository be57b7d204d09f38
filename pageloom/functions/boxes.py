"""Box arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(value: Column, size: Column) -> Column:
    """Pixels to 0..1000, truncated and clamped; null where the page has no positive size."""
    return F.when(size > 0, F.least(F.lit(1000), F.greatest(F.lit(0), F.floor(value * 1000 / size)))).cast("int")


def normalized_box(box: tuple[Column, ...], width: Column, height: Column) -> tuple[Column, ...]:
    """A box in 0..1000 whose far edges are not before its near ones; null where the page has no positive size."""
    x0, y0, x1, y1 = (normalized(v, s) for v, s in zip(box, (width, height, width, height), strict=True))
    return x0, y0, F.greatest(x0, x1), F.greatest(y0, y1)


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1); 0 if they don't meet or both are empty."""
    w = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def pixels(value: Column, size: Column) -> Column:
    """0..1000 to pixels, truncated."""
    return (value / 1000 * size).cast("int")


def percent(box: tuple[Column, ...], width: Column, height: Column) -> tuple[Column, ...]:
    """(x, y, width, height) in percent of the page, for annotation tools."""
    x0, y0, x1, y1 = box
    return x0 / width * 100, y0 / height * 100, (x1 - x0) / width * 100, (y1 - y0) / height * 100


def padded(box: tuple[Column, ...], by: int) -> tuple[Column, ...]:
    x0, y0, x1, y1 = box
    return x0 - by, y0 - by, x1 + by, y1 + by


def from_percent(rect: tuple[Column, ...], width: Column, height: Column) -> tuple[Column, ...]:
    """(x, y, width, height) in percent of the page to a box in pixels."""
    x, y, w, h = rect
    x0, y0 = x / 100 * width, y / 100 * height
    return x0, y0, x0 + w / 100 * width, y0 + h / 100 * height
