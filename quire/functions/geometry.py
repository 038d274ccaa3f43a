"""Bounding boxes as Column expressions; a box is struct<l, t, r, b: double, coord_origin: string>.

Every function stays inside code generation. Boxes of different origins raise an error in functions that compare
them (``strict=False``: null instead).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOP, BOTTOM = "TOPLEFT", "BOTTOMLEFT"
EPS = 1.0e-6


def box(l: Column, t: Column, r: Column, b: Column, origin: Column | str = TOP) -> Column:  # noqa: E741
    o = F.lit(origin) if isinstance(origin, str) else origin
    d = lambda c, name: c.cast("double").alias(name)
    return F.struct(d(l, "l"), d(t, "t"), d(r, "r"), d(b, "b"), o.alias("coord_origin"))


def is_top(x: Column) -> Column:
    return x["coord_origin"] == TOP


def width(x: Column) -> Column:
    """Signed."""
    return x["r"] - x["l"]


def height(x: Column) -> Column:
    return F.abs(x["t"] - x["b"])


def area(x: Column) -> Column:
    return F.abs(width(x)) * height(x)


def resize_by_scale(x: Column, sx: Column, sy: Column) -> Column:
    return box(x["l"] * sx, x["t"] * sy, x["r"] * sx, x["b"] * sy, x["coord_origin"])


def scaled(x: Column, scale: Column) -> Column:
    return resize_by_scale(x, scale, scale)


def scale_to_size(x: Column, old_w: Column, old_h: Column, new_w: Column, new_h: Column) -> Column:
    return resize_by_scale(x, new_w / old_w, new_h / old_h)


def normalized(x: Column, page_w: Column, page_h: Column) -> Column:
    return scale_to_size(x, page_w, page_h, F.lit(1.0), F.lit(1.0))


def expand_by_scale(x: Column, sx: Column, sy: Column) -> Column:
    dx, dy = width(x) * sx, F.when(is_top(x), height(x) * sy).otherwise(-(height(x) * sy))
    return box(x["l"] - dx, x["t"] - dy, x["r"] + dx, x["b"] + dy, x["coord_origin"])


def as_tuple(x: Column) -> Column:
    top = is_top(x)
    return F.array(x["l"], F.when(top, x["t"]).otherwise(x["b"]), x["r"], F.when(top, x["b"]).otherwise(x["t"]))


def from_tuple(c: Column, origin: Column | str = TOP) -> Column:
    """Four numbers; inverted ones change places."""
    o = F.lit(origin) if isinstance(origin, str) else origin
    low, high = F.least(c[1], c[3]), F.greatest(c[1], c[3])
    top = o == TOP
    return box(F.least(c[0], c[2]), F.when(top, low).otherwise(high), F.greatest(c[0], c[2]), F.when(top, high).otherwise(low), o)


def _same(x: Column, y: Column, value: Column, strict: bool) -> Column:
    other = F.raise_error(F.lit("boxes have different origins")) if strict else F.lit(None)
    return F.when(x["coord_origin"] == y["coord_origin"], value).otherwise(other)


def _y(x: Column) -> tuple[Column, Column]:
    """(low, high) along the axis in which the box's own origin counts."""
    top = is_top(x)
    return F.when(top, x["t"]).otherwise(x["b"]), F.when(top, x["b"]).otherwise(x["t"])


def intersection_area(x: Column, y: Column, strict: bool = True) -> Column:
    (x0, x1), (y0, y1) = _y(x), _y(y)
    w = F.least(x["r"], y["r"]) - F.greatest(x["l"], y["l"])
    h = F.least(x1, y1) - F.greatest(x0, y0)
    return _same(x, y, F.when((w <= 0) | (h <= 0), F.lit(0.0)).otherwise(w * h), strict)


def iou(x: Column, y: Column, eps: float = EPS, strict: bool = True) -> Column:
    """Intersection over union; eps is added to the union."""
    i = intersection_area(x, y, strict)
    return i / (area(x) + area(y) - i + F.lit(eps))


def ios(x: Column, y: Column, strict: bool = True) -> Column:
    """Intersection over the first box, 0 if that has no area."""
    return F.when(area(x) > 0, intersection_area(x, y, strict) / area(x)).otherwise(F.lit(0.0))


def intersection_box(x: Column, y: Column, strict: bool = True) -> Column:
    (x0, x1), (y0, y1) = _y(x), _y(y)
    left, right, low, high = F.greatest(x["l"], y["l"]), F.least(x["r"], y["r"]), F.greatest(x0, y0), F.least(x1, y1)
    top = is_top(x)
    made = box(left, F.when(top, low).otherwise(high), right, F.when(top, high).otherwise(low), x["coord_origin"])
    return _same(x, y, F.when((right > left) & (high > low), made), strict)


def _flip(x: Column, page_h: Column, to: str) -> Column:
    return F.when(x["coord_origin"] == to, x).otherwise(box(x["l"], page_h - x["t"], x["r"], page_h - x["b"], to))


def to_bottom_left(x: Column, page_h: Column) -> Column:
    return _flip(x, page_h, BOTTOM)


def to_top_left(x: Column, page_h: Column) -> Column:
    return _flip(x, page_h, TOP)


def overlaps_horizontally(x: Column, y: Column) -> Column:
    return ~((x["r"] <= y["l"]) | (y["r"] <= x["l"]))


def overlaps_vertically(x: Column, y: Column, strict: bool = True) -> Column:
    (x0, x1), (y0, y1) = _y(x), _y(y)
    return _same(x, y, ~((x1 <= y0) | (y1 <= x0)), strict)


def overlaps(x: Column, y: Column, strict: bool = True) -> Column:
    return overlaps_horizontally(x, y) & overlaps_vertically(x, y, strict)


def overlaps_vertically_with_iou(x: Column, y: Column, least: Column, strict: bool = True) -> Column:
    (x0, x1), (y0, y1) = _y(x), _y(y)
    share = (F.least(x1, y1) - F.greatest(x0, y0)) / (F.greatest(x1, y1) - F.least(x0, y0))
    return F.when(overlaps_vertically(x, y, strict), share > least).otherwise(F.lit(False))


def is_left_of(x: Column, y: Column) -> Column:
    return x["l"] < y["l"]


def is_strictly_left_of(x: Column, y: Column, eps: float = 0.001) -> Column:
    return x["r"] + F.lit(eps) < y["l"]


def is_above(x: Column, y: Column, strict: bool = True) -> Column:
    return _same(x, y, F.when(is_top(x), x["t"] < y["t"]).otherwise(x["t"] > y["t"]), strict)


def is_strictly_above(x: Column, y: Column, eps: float = 0.001, strict: bool = True) -> Column:
    """The tolerance widens the test for bottom-left boxes and narrows it for top-left ones."""
    return _same(x, y, F.when(is_top(x), x["b"] + F.lit(eps) < y["t"]).otherwise(x["b"] + F.lit(eps) > y["t"]), strict)


def is_horizontally_connected(x: Column, y: Column, z: Column, strict: bool = True) -> Column:
    """Is ``x`` clear of the vertical band that ``y`` and ``z`` span, and does it reach between them horizontally?"""
    (y0, y1), (z0, z1), (x0, x1) = _y(y), _y(z), _y(x)
    clear = ~((x0 < F.greatest(y1, z1)) & (F.least(y0, z0) < x1))
    return _same(x, y, _same(x, z, clear & (x["l"] < y["r"]) & (z["l"] < x["r"]), strict), strict)


def x_overlap(x: Column, y: Column, strict: bool = True) -> Column:
    return _same(x, y, F.greatest(F.lit(0.0), F.least(x["r"], y["r"]) - F.greatest(x["l"], y["l"])), strict)


def y_overlap(x: Column, y: Column, strict: bool = True) -> Column:
    (x0, x1), (y0, y1) = _y(x), _y(y)
    return _same(x, y, F.greatest(F.lit(0.0), F.least(x1, y1) - F.greatest(x0, y0)), strict)


def union_area(x: Column, y: Column, strict: bool = True) -> Column:
    return area(x) + area(y) - intersection_area(x, y, strict)


def x_union(x: Column, y: Column, strict: bool = True) -> Column:
    return _same(x, y, F.greatest(F.lit(0.0), F.greatest(x["r"], y["r"]) - F.least(x["l"], y["l"])), strict)


def y_union(x: Column, y: Column, strict: bool = True) -> Column:
    (x0, x1), (y0, y1) = _y(x), _y(y)
    return _same(x, y, F.greatest(F.lit(0.0), F.greatest(x1, y1) - F.least(x0, y0)), strict)


def enclosing(x: Column) -> Column:
    """Aggregate: the box around all boxes of a group, which must share an origin."""
    top = F.min("coord_origin" if isinstance(x, str) else x["coord_origin"]) == TOP
    t = F.when(top, F.min(x["t"])).otherwise(F.max(x["t"]))
    b = F.when(top, F.max(x["b"])).otherwise(F.min(x["b"]))
    same = F.min(x["coord_origin"]) == F.max(x["coord_origin"])
    made = box(F.min(x["l"]), t, F.max(x["r"]), b, F.min(x["coord_origin"]))
    return F.when(same, made).otherwise(F.raise_error(F.lit("boxes have different origins")))


def location_tokens(x: Column, page_w: Column, page_h: Column, size: int = 500) -> Column:
    """<loc_..> x 4 of a top-left box: half-even rounding, at most size - 1, inverted corners in order."""
    q = lambda v, whole: F.least(F.greatest(F.bround(v / whole * size, 0).cast("int"), F.lit(0)), F.lit(size - 1))
    x0, x1, y0, y1 = q(x["l"], page_w), q(x["r"], page_w), q(x["t"], page_h), q(x["b"], page_h)
    parts = [F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1)]
    return reduce(F.concat, [F.concat(F.lit("<loc_"), p.cast("string"), F.lit(">")) for p in parts])


# ------------------------------------------------------------- rotated rectangles
def rect(xs: list[Column], ys: list[Column], origin: str = TOP) -> Column:
    """struct<r_x0, r_y0, ... r_x3, r_y3, coord_origin>: corners from the bottom left on, counter-clockwise in reading."""
    names = [f"r_{a}{i}" for i in range(4) for a in "xy"]
    values = [v for p in zip(xs, ys, strict=True) for v in p]
    return F.struct(*[v.cast("double").alias(n) for n, v in zip(names, values, strict=True)], F.lit(origin).alias("coord_origin"))


def rect_width(x: Column) -> Column:
    return F.sqrt(F.pow(x["r_x1"] - x["r_x0"], F.lit(2)) + F.pow(x["r_y1"] - x["r_y0"], F.lit(2)))


def rect_height(x: Column) -> Column:
    return F.sqrt(F.pow(x["r_x3"] - x["r_x0"], F.lit(2)) + F.pow(x["r_y3"] - x["r_y0"], F.lit(2)))


def rect_angle(x: Column) -> Column:
    """Radians from 0 to two pi, counter-clockwise, of the line from the middle of the left side to that of the right."""
    mid = lambda a, i, j: (x[f"r_{a}{i}"] + x[f"r_{a}{j}"]) / 2
    dx = mid("x", 1, 2) - mid("x", 0, 3)
    dy = mid("y", 1, 2) - mid("y", 0, 3)
    dy = F.when(x["coord_origin"] == TOP, -dy).otherwise(dy)
    steep = F.when(dy > 0, F.lit(math.pi / 2)).otherwise(F.lit(-math.pi / 2))
    base = F.when(F.abs(dy) < 1.0e-3, F.lit(0.0)).when(F.abs(dx) < 1.0e-3, steep).otherwise(F.atan(dy / dx))
    return F.pmod(base + F.when(dx < 0, F.lit(math.pi)).otherwise(F.lit(0.0)), F.lit(2 * math.pi))


def rect_angle_360(x: Column) -> Column:
    return F.bround(rect_angle(x) / F.lit(math.pi) * 180, 0).cast("int")


def rect_from_box(x: Column) -> Column:
    names = [f"r_{a}{i}" for i in range(4) for a in "xy"]
    values = [x["l"], x["b"], x["r"], x["b"], x["r"], x["t"], x["l"], x["t"]]
    return F.struct(*[v.alias(n) for n, v in zip(names, values, strict=True)], x["coord_origin"].alias("coord_origin"))


def rect_polygon(x: Column) -> Column:
    return F.array(*[F.struct(x[f"r_x{i}"].alias("x"), x[f"r_y{i}"].alias("y")) for i in range(4)])


def rect_flip(x: Column, page_h: Column, to: str) -> Column:
    """``x`` with the other origin, unchanged if it has it."""
    made = [(x[f"r_{a}{i}"] if a == "x" else page_h - x[f"r_{a}{i}"]).alias(f"r_{a}{i}") for i in range(4) for a in "xy"]
    return F.when(x["coord_origin"] == to, x).otherwise(F.struct(*made, F.lit(to).alias("coord_origin")))


def rect_centre(x: Column) -> Column:
    mid = lambda a: (x[f"r_{a}0"] + x[f"r_{a}1"] + x[f"r_{a}2"] + x[f"r_{a}3"]) / 4
    return F.struct(mid("x").alias("x"), mid("y").alias("y"))


def rect_to_box(x: Column) -> Column:
    xs, ys = [x[f"r_x{i}"] for i in range(4)], [x[f"r_y{i}"] for i in range(4)]
    top = x["coord_origin"] == TOP
    return box(F.least(*xs), F.when(top, F.least(*ys)).otherwise(F.greatest(*ys)), F.greatest(*xs), F.when(top, F.greatest(*ys)).otherwise(F.least(*ys)), x["coord_origin"])
