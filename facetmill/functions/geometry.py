"""Boxes struct<x0, top, x1, bottom> in points from the top left corner, over Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0, top, x1, bottom) -> Column:
    return F.struct(*[(c if isinstance(c, Column) else F.col(c)).cast("double").alias(n) for c, n in ((x0, "x0"), (top, "top"), (x1, "x1"), (bottom, "bottom"))])


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["bottom"] - b["top"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    """The common area; 0 for boxes that only touch, null if a coordinate is null."""
    w, h = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])
    known = a["x0"] + a["x1"] + a["top"] + a["bottom"] + b["x0"] + b["x1"] + b["top"] + b["bottom"]
    return F.when(known.isNotNull(), F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0)))


def overlap_of_smaller(a: Column, b: Column) -> Column:
    """The common area as a share of the smaller box, 0 where that has no area."""
    return F.coalesce(F.try_divide(intersection(a, b), F.least(area(a), area(b))), F.lit(0.0))


def contains_point(b: Column, x: Column, y: Column) -> Column:
    return (b["x0"] <= x) & (x <= b["x1"]) & (b["top"] <= y) & (y <= b["bottom"])


def center_x(b: Column) -> Column:
    return (b["x0"] + b["x1"]) / 2


def center_y(b: Column) -> Column:
    return (b["top"] + b["bottom"]) / 2


def clip(b: Column, width: Column, height: Column) -> Column:
    edge = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most))
    return box(edge(b["x0"], width), edge(b["top"], height), edge(b["x1"], width), edge(b["bottom"], height))


def flip(b: Column, width: Column, height: Column) -> Column:
    """A box measured from the bottom left corner, clamped to the page."""
    return clip(box(b["x0"], height - b["bottom"], b["x1"], height - b["top"]), width, height)


def from_fractions(b: Column, width: Column, height: Column) -> Column:
    """A box in fractions of the page, in points and clamped."""
    return clip(box(b["x0"] * width, b["top"] * height, b["x1"] * width, b["bottom"] * height), width, height)


def from_pixels(b: Column, dpi: Column) -> Column:
    k = F.lit(72.0) / dpi
    return box(b["x0"] * k, b["top"] * k, b["x1"] * k, b["bottom"] * k)


def same_line(a: Column, b: Column) -> Column:
    """The vertical overlap exceeds half the lower of the two heights."""
    shared = F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])
    return shared > F.least(a["bottom"] - a["top"], b["bottom"] - b["top"]) * 0.5


def union_of(b: str) -> Column:
    """Aggregate: the box around a group's boxes."""
    return box(F.min(f"{b}.x0"), F.min(f"{b}.top"), F.max(f"{b}.x1"), F.max(f"{b}.bottom"))
