"""Rectangles as structs (x0, y0, x1, y1): predicates and measures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0, y0, x1, y1) -> Column:
    return F.struct(F.col(x0).alias("x0"), F.col(y0).alias("y0"), F.col(x1).alias("x1"), F.col(y1).alias("y1")) if isinstance(x0, str) else F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def _c(b) -> Column:
    return F.col(b) if isinstance(b, str) else b


def area(b) -> Column:
    b = _c(b)
    return F.greatest(F.lit(0), b["x1"] - b["x0"]) * F.greatest(F.lit(0), b["y1"] - b["y0"])


def overlap(a, b) -> Column:
    """Area of the intersection."""
    a, b = _c(a), _c(b)
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def intersects(a, b) -> Column:
    return overlap(a, b) > 0


def inside(a, b) -> Column:
    """b lies within a."""
    a, b = _c(a), _c(b)
    return (b["x0"] >= a["x0"]) & (b["y0"] >= a["y0"]) & (b["x1"] <= a["x1"]) & (b["y1"] <= a["y1"])


def covers(a, b, threshold: float = 1.0) -> Column:
    """a holds a share of `threshold` of b's area, rounded to two digits, and along a's own longer side is as long as b, but for a point.

    A box without area is covered by none.
    """
    a, b = _c(a), _c(b)
    share = F.round(overlap(a, b) / F.nullif(area(b), F.lit(0)), 2) >= threshold
    width, height = a["x1"] - a["x0"], a["y1"] - a["y0"]
    length = F.when(width >= height, width + 1 >= b["x1"] - b["x0"]).otherwise(height + 1 >= b["y1"] - b["y0"])
    return F.coalesce(share & length, F.lit(False))


def union(a, b) -> Column:
    a, b = _c(a), _c(b)
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def main_box(a, b, threshold: float) -> Column:
    """The union box if the overlap is a share of `threshold` of the smaller area; boxes that meet without area share 1e-6."""
    a, b = _c(a), _c(b)
    touch = (F.least(a["x1"], b["x1"]) >= F.greatest(a["x0"], b["x0"])) & (F.least(a["y1"], b["y1"]) >= F.greatest(a["y0"], b["y0"]))
    share = F.when(overlap(a, b) > 0, overlap(a, b) / F.least(area(a), area(b))).otherwise(F.lit(1e-6))
    return F.when(touch & (share >= threshold), union(a, b))


def _aligned(a: Column, b: Column, low: str, high: str, factor: float) -> Column:
    la, lb = a[high] - a[low], b[high] - b[low]
    whole = F.greatest(a[high], b[high]) - F.least(a[low], b[low])
    return la + lb - whole + 1e-3 >= factor * F.least(la, lb)


def in_column(a, b, factor: float = 0.0) -> Column:
    """The boxes overlap in x by a share of `factor` of the narrower one."""
    return _aligned(_c(a), _c(b), "x0", "x1", factor)


def in_line(a, b, factor: float = 0.0) -> Column:
    """The boxes overlap in y by a share of `factor` of the lower one."""
    return _aligned(_c(a), _c(b), "y0", "y1", factor)


def in_row(a, b) -> Column:
    """Each box's middle lies above the other's lower edge."""
    a, b = _c(a), _c(b)
    return ((a["y0"] + a["y1"]) / 2 < b["y1"]) & ((b["y0"] + b["y1"]) / 2 < a["y1"])


def same_place(a, b, share: float = 0.7) -> Column:
    """The intersection is more than `share` of the union."""
    both = overlap(a, b)
    return both > share * (area(a) + area(b) - both)


def iou_class(a, b, share: float = 0.6) -> Column:
    """none, match (above the share), or small (they meet)."""
    both = overlap(a, b)
    return F.when(both <= 0, F.lit("none")).when(both / (area(a) + area(b) - both) > share, F.lit("match")).otherwise(F.lit("small"))


def centred(b, left, right, share: float = 0.9, shift: float = 30.0) -> Column:
    """Narrower than a share of the column, its middle near the column's."""
    b, left, right = _c(b), _c(left), _c(right)
    return (b["x1"] - b["x0"] < share * (right - left)) & (F.abs((b["x0"] + b["x1"]) / 2 - (left + right) / 2) < shift)
