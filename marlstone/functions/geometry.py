"""Box geometry as column expressions. Boxes are (x, y, w, h) columns unless a name says xyxy."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    """Four columns."""

    x: Column
    y: Column
    w: Column
    h: Column


def box(prefix: str = "", names: tuple[str, str, str, str] = ("x", "y", "w", "h")) -> Box:
    return Box(*(F.col(prefix + n) for n in names))


def area(b: Box) -> Column:
    """Width times height, neither below 0."""
    return F.greatest(b.w, F.lit(0)) * F.greatest(b.h, F.lit(0))


def to_xyxy(b: Box) -> tuple[Column, Column, Column, Column]:
    return b.x, b.y, b.x + b.w, b.y + b.h


def from_xyxy(x1: Column, y1: Column, x2: Column, y2: Column) -> Box:
    """Negative sides become 0."""
    return Box(x1, y1, F.greatest(x2 - x1, F.lit(0)), F.greatest(y2 - y1, F.lit(0)))


def intersection(a: Box, b: Box) -> Column:
    """Overlap area; 0 for boxes that only touch."""
    w = F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x)
    h = F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y)
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0))


def apart(a: Box, b: Box) -> Column:
    """Whether one box ends before the other begins, which is told in few steps; null where a side is missing."""
    return (a.x >= b.x + b.w) | (b.x >= a.x + a.w) | (a.y >= b.y + b.h) | (b.y >= a.y + a.h)


def meets(a: Box, b: Box) -> Column:
    """Whether the intersection is over 0. Boxes that lie apart, as most do, are told without it: functions over arrays are interpreted, step by step."""
    return F.when(apart(a, b), F.lit(False)).otherwise(intersection(a, b) > 0)


def union_area(a: Box, b: Box) -> Column:
    return area(a) + area(b) - intersection(a, b)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0.0 without overlap or where the union is not positive."""
    inter, whole = intersection(a, b), union_area(a, b)
    return F.when((inter > 0) & (whole > 0), inter / whole).otherwise(F.lit(0.0))


def io_min(a: Box, b: Box, floor: float | None = 1.0) -> Column:
    """Intersection over the smaller area, which counts as ``floor`` at least; without a floor 0.0 for an empty one."""
    least = F.least(area(a), area(b))
    inter = intersection(a, b)
    return inter / F.greatest(least, F.lit(floor)) if floor is not None else F.when(least > 0, inter / least).otherwise(F.lit(0.0))


def inside_ratio(b: Box, width: Column, height: Column) -> Column:
    """Share of a box that lies in the frame; its area counts as 1 at least."""
    frame = Box(F.lit(0), F.lit(0), width, height)
    return intersection(b, frame) / F.greatest(area(b), F.lit(1))


def containment(inner: Box, outer: Box) -> Column:
    """Share of ``inner`` that ``outer`` covers; 0.0 for an empty ``inner``."""
    return F.when(area(inner) > 0, intersection(inner, outer) / area(inner)).otherwise(F.lit(0.0))


def edge_margin(b: Box, width: Column, height: Column) -> Column:
    """Least distance to a side of the frame; negative outside."""
    return F.least(b.x, b.y, width - b.x - b.w, height - b.y - b.h)


def rescale(b: Box, sx: Column, sy: Column) -> Box:
    return Box(b.x * sx, b.y * sy, b.w * sx, b.h * sy)


def flipped(b: Box, width: Column) -> Box:
    """Mirrored left to right in a frame."""
    return b._replace(x=width - b.x - b.w)


def moved(b: Box, scale: Column, dx: Column, dy: Column) -> Box:
    """Scaled about the origin, then shifted."""
    return Box(b.x * scale + dx, b.y * scale + dy, b.w * scale, b.h * scale)


def centre(b: Box) -> tuple[Column, Column]:
    return b.x + b.w / 2, b.y + b.h / 2


def centre_in(b: Box, region: Box) -> Column:
    """Whether the centre lies in a region, sides included."""
    cx, cy = centre(b)
    return (cx >= region.x) & (cx <= region.x + region.w) & (cy >= region.y) & (cy <= region.y + region.h)


def in_person_context(head: Box, person: Box, upper: float = 0.65, expand: bool = True) -> Column:
    """Whether a head's centre lies in the upper part of a person, widened by the head's size if ``expand``."""
    cx, cy = centre(head)
    side, below = (head.w, head.h) if expand else (F.lit(0), F.lit(0))
    return (cx >= person.x - side) & (cx <= person.x + person.w + side) & (cy >= person.y - below) & (cy <= person.y + person.h * upper + below)


def normalised(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, offset: int = 0) -> tuple[Box, dict[str, Column]]:
    """Rounded half to even, put in order, the minima shifted by ``offset``, clipped to the frame.

    Also says what was done: rounded, swapped, clipped and empty, as booleans; an empty box is to be dropped.
    """
    r = [F.bround(c, 0).cast("int") for c in (x1, y1, x2, y2)]
    left, right, top, bottom = F.least(r[0], r[2]), F.greatest(r[0], r[2]), F.least(r[1], r[3]), F.greatest(r[1], r[3])
    left, top = left - offset, top - offset
    at = (F.greatest(left, F.lit(0)), F.greatest(top, F.lit(0)), F.least(right, width), F.least(bottom, height))
    out = Box(at[0], at[1], at[2] - at[0], at[3] - at[1])
    done = {
        "rounded": (r[0] != x1) | (r[1] != y1) | (r[2] != x2) | (r[3] != y2),
        "swapped": (r[0] > r[2]) | (r[1] > r[3]),
        "clipped": (at[0] != left) | (at[1] != top) | (at[2] != right) | (at[3] != bottom),
        "empty": (out.w <= 0) | (out.h <= 0),
    }
    return out, done


def bucket_half_open(value: Column, ranges: list[tuple[str, float, float]]) -> Column:
    """Name of the range [low, high) that holds a value; the last is closed. Ranges must tile; outside them an error."""
    ranges = sorted(ranges, key=lambda r: r[1])
    if any(a[2] != b[1] for a, b in zip(ranges, ranges[1:])):
        raise ValueError("ranges must tile")
    out = F.when((value >= ranges[-1][1]) & (value <= ranges[-1][2]), F.lit(ranges[-1][0]))
    for name, low, high in ranges[:-1]:
        out = out.when((value >= low) & (value < high), F.lit(name))
    return F.coalesce(out, F.when(value.isNotNull(), F.raise_error(F.concat(F.lit("outside all ranges: "), value.cast("string"))).cast("string")))


def geometry_filter(b: Box, width: Column, height: Column, *, max_area: float, max_height: float, min_aspect: float, max_aspect: float, max_outside: float) -> Column:
    """Whether a box has a plausible share of the frame, shape and place; bounds are inclusive, empty boxes fail."""
    ok = (b.w > 0) & (b.h > 0)
    tests = (area(b) / (width * height) <= max_area) & (b.h / height <= max_height) & (b.w / F.greatest(b.h, F.lit(1))).between(min_aspect, max_aspect) & (1 - inside_ratio(b, width, height) <= max_outside)
    return ok & tests


def pair_descriptor(head: Box, hat: Box) -> Column:
    """Placement of a hat against a head in units of the head: dx, dy, overlap_y, r_w, r_h, iou; null for an empty head."""
    hx, hy = centre(head)
    cx, cy = centre(hat)
    overlap = F.greatest(F.least(head.y + head.h, hat.y + hat.h) - F.greatest(head.y, hat.y), F.lit(0)) / head.h
    fields = F.struct(((cx - hx) / head.w).alias("dx"), ((cy - hy) / head.h).alias("dy"), overlap.alias("overlap_y"), (hat.w / head.w).alias("r_w"), (hat.h / head.h).alias("r_h"), iou(head, hat).alias("iou"))
    return F.when((head.w > 0) & (head.h > 0), fields)


def worn(pair: Column, *, max_dx: float = 0.6, min_dy: float = -1.0, max_dy: float = 0.4, max_ratio: float = 2.5, min_ratio: float = 0.4) -> Column:
    """Whether a pair descriptor is that of a hat that is worn; false for a null one."""
    ok = (F.abs(pair["dx"]) <= max_dx) & pair["dy"].between(min_dy, max_dy) & pair["r_w"].between(min_ratio, max_ratio)
    return F.coalesce(ok, F.lit(False))
