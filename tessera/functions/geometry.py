"""Axis-aligned integer boxes as structs x, y, width, height; all functions take and return Columns and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | int | float


def _col(v: Number) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def whole(v: Number) -> Column:
    """Rounds half to even, as an integer."""
    return F.rint(_col(v)).cast("int")


def box(x: Number, y: Number, width: Number, height: Number) -> Column:
    return F.struct(_col(x).cast("int").alias("x"), _col(y).cast("int").alias("y"), _col(width).cast("int").alias("width"), _col(height).cast("int").alias("height"))


def right(b: Column) -> Column:
    return b["x"] + b["width"]


def bottom(b: Column) -> Column:
    return b["y"] + b["height"]


def area(b: Column) -> Column:
    """Negative sides count as 0."""
    return F.greatest(F.lit(0), b["width"]) * F.greatest(F.lit(0), b["height"])


def aspect_ratio(b: Column) -> Column:
    return F.greatest(b["width"], b["height"]) / F.greatest(F.lit(1), F.least(b["width"], b["height"]))


def from_corners(x1: Number, y1: Number, x2: Number, y2: Number) -> Column:
    """Corners in any order; both edges are rounded half to even, sizes from the unrounded edges."""
    x1, y1, x2, y2 = map(_col, (x1, y1, x2, y2))
    left, top = F.least(x1, x2), F.least(y1, y2)
    return box(whole(left), whole(top), whole(F.greatest(x1, x2) - left), whole(F.greatest(y1, y2) - top))


def intersection(a: Column, b: Column) -> Column:
    """Area that both cover."""
    wide = F.least(right(a), right(b)) - F.greatest(a["x"], b["x"])
    high = F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"])
    return F.greatest(F.lit(0), wide) * F.greatest(F.lit(0), high)


def iou(a: Column, b: Column) -> Column:
    joint = area(a) + area(b) - intersection(a, b)
    return F.when(joint > 0, intersection(a, b) / joint).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Shared area over the smaller box's."""
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, intersection(a, b) / smaller).otherwise(0.0)


def union(a: Column, b: Column) -> Column:
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return box(x, y, F.greatest(right(a), right(b)) - x, F.greatest(bottom(a), bottom(b)) - y)


def clip(b: Column, width: Number, height: Number) -> Column:
    """The part inside an image; size 0 if it lies outside."""
    width, height, none = _col(width), _col(height), F.lit(0)
    x1, y1 = F.least(F.greatest(b["x"], none), width), F.least(F.greatest(b["y"], none), height)
    x2, y2 = F.least(F.greatest(right(b), none), width), F.least(F.greatest(bottom(b), none), height)
    return box(x1, y1, F.greatest(none, x2 - x1), F.greatest(none, y2 - y1))


def scale(b: Column, factor: Number) -> Column:
    f = _col(factor)
    return from_corners(b["x"] * f, b["y"] * f, right(b) * f, bottom(b) * f)


def touches_border(b: Column, width: Number, height: Number, margin: Number = 2) -> Column:
    m = _col(margin)
    return (b["x"] <= m) | (b["y"] <= m) | (right(b) >= _col(width) - m) | (bottom(b) >= _col(height) - m)


def padded(b: Column, width: Number, height: Number, percent: Number = 10.0, square: bool = True, strict: bool = False) -> Column:
    """A margin of a percentage of the longer side; squares are shifted into the image, then clipped. Null for an empty box or, if strict, an error."""
    long = F.greatest(b["width"], b["height"])
    pad = whole(long * F.greatest(F.lit(0.0), _col(percent)) / 100.0)
    if square:
        side = long + 2 * pad
        x = whole(b["x"] + b["width"] / 2 - side / 2)
        y = whole(b["y"] + b["height"] / 2 - side / 2)
        x = F.least(F.greatest(x, F.lit(0)), F.greatest(F.lit(0), _col(width) - side))
        y = F.least(F.greatest(y, F.lit(0)), F.greatest(F.lit(0), _col(height) - side))
        grown = box(x, y, side, side)
    else:
        grown = box(b["x"] - pad, b["y"] - pad, b["width"] + 2 * pad, b["height"] + 2 * pad)
    whole_box = F.when((b["width"] > 0) & (b["height"] > 0), clip(grown, width, height))
    return F.when((b["width"] <= 0) | (b["height"] <= 0), F.raise_error(F.lit("an empty box can't be padded"))).otherwise(whole_box) if strict else whole_box


def halves(b: Column, direction: str | None = None) -> Column:
    """Array of two boxes: cut `vertical` (side by side), `horizontal`, or across the longer side; an odd pixel goes to the second."""
    left = F.floor(b["width"] / 2).cast("int")
    top = F.floor(b["height"] / 2).cast("int")
    upright = F.array(box(b["x"], b["y"], left, b["height"]), box(b["x"] + left, b["y"], b["width"] - left, b["height"]))
    lying = F.array(box(b["x"], b["y"], b["width"], top), box(b["x"], b["y"] + top, b["width"], b["height"] - top))
    if direction == "vertical":
        return upright
    if direction == "horizontal":
        return lying
    return F.when(b["width"] >= b["height"], upright).otherwise(lying)
