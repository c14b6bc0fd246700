"""Boxes and transforms as struct arithmetic; a box is struct<x0, y0, x1, y1>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0, y0, x1, y1) -> Column:
    """Corners in order, rounded to four decimals."""
    low = lambda a, b: F.round(F.least(a, b), 4)
    high = lambda a, b: F.round(F.greatest(a, b), 4)
    return F.struct(low(x0, x1).alias("x0"), low(y0, y1).alias("y0"), high(x0, x1).alias("x1"), high(y0, y1).alias("y1"))


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def iou(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    both = F.greatest(zero, F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])) * F.greatest(zero, F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def contains(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    return (b["x0"] >= a["x0"] - tolerance) & (b["y0"] >= a["y0"] - tolerance) & (b["x1"] <= a["x1"] + tolerance) & (b["y1"] <= a["y1"] + tolerance)


def clip(b: Column) -> Column:
    """The part of a box inside the unit square."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), b[c])).alias(c)
    return F.struct(*[unit(c) for c in ("x0", "y0", "x1", "y1")])


def scale(b: Column, width: Column, height: Column) -> Column:
    """Unit coordinates to points; with 1 / width and 1 / height back."""
    return F.struct((b["x0"] * width).alias("x0"), (b["y0"] * height).alias("y0"), (b["x1"] * width).alias("x1"), (b["y1"] * height).alias("y1"))


def expand(b: Column, share: float = 0.2) -> Column:
    """A box grown by a share of its sides, clipped to the unit square."""
    dx, dy = (b["x1"] - b["x0"]) * share / 2, (b["y1"] - b["y0"]) * share / 2
    return clip(F.struct((b["x0"] - dx).alias("x0"), (b["y0"] - dy).alias("y0"), (b["x1"] + dx).alias("x1"), (b["y1"] + dy).alias("y1")))


def crop_to_page(b: Column, crop: Column) -> Column:
    """A box in crop coordinates as page coordinates."""
    w, h = crop["x1"] - crop["x0"], crop["y1"] - crop["y0"]
    return F.struct((crop["x0"] + b["x0"] * w).alias("x0"), (crop["y0"] + b["y0"] * h).alias("y0"), (crop["x0"] + b["x1"] * w).alias("x1"), (crop["y0"] + b["y1"] * h).alias("y1"))


def transform(m: Column, x: Column, y: Column) -> Column:
    """Affine transform m = array(a, b, c, d, e, f): (a x + c y + e, b x + d y + f)."""
    return F.struct((m[0] * x + m[2] * y + m[4]).alias("x"), (m[1] * x + m[3] * y + m[5]).alias("y"))


def inverse(m: Column) -> Column:
    """The inverse transform; raises when the determinant is below 1e-9."""
    det = m[0] * m[3] - m[1] * m[2]
    safe = F.when(F.abs(det) < 1e-9, F.raise_error(F.lit("singular transform"))).otherwise(det)
    return F.array(m[3] / safe, -m[1] / safe, -m[2] / safe, m[0] / safe, (m[2] * m[5] - m[3] * m[4]) / safe, (m[1] * m[4] - m[0] * m[5]) / safe)


def proposed_regions(text: Column, most: int = 4) -> Column:
    """Boxes of four numbers in brackets, 0 to 1000 as 0 to 1, in order, of positive area."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[\s*\d+(?:\.\d+)?(?:\s*,\s*\d+(?:\.\d+)?){3}\s*\]"), F.lit(0))
    numbers = F.transform(found, lambda s: F.transform(F.regexp_extract_all(s, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda v: v.cast("double")))
    unit = F.transform(numbers, lambda v: F.when(F.array_max(v) > 1, F.transform(v, lambda c: c / 1000)).otherwise(v))
    boxes = F.transform(unit, lambda v: clip(box(v[0], v[1], v[2], v[3])))
    return F.slice(F.filter(boxes, lambda b: area(b) > 0), 1, most)
