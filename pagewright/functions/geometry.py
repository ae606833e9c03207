"""Column functions over normalised boxes (x1, y1, x2, y2 within 0 and 1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]



def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def clamp(c: Column, low=0.0, high=1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def area(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def intersection(a: Box, b: Box) -> Column:
    wide = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((wide > 0) & (high > 0), wide * high).otherwise(F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 without a positive overlap or union."""
    common = intersection(a, b)
    union = area(a) + area(b) - common
    return F.when((common > 0) & (union > 0), common / union).otherwise(F.lit(0.0))


def overlap_of_smaller(a: Box, b: Box) -> Column:
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(F.lit(0.0))


def box_error(b: Box) -> Column:
    """Why a box is not valid, else null."""
    out_of_range = ~(b[0].between(0, 1) & b[1].between(0, 1) & b[2].between(0, 1) & b[3].between(0, 1))
    return F.when(out_of_range, "coordinates out of range").when((b[2] <= b[0]) | (b[3] <= b[1]), "empty box")


def item_columns(b: Box) -> dict[str, Column]:
    """Clamped corners, size and centre of a box."""
    x1, y1, x2, y2 = (clamp(c) for c in b)
    wide, high = F.greatest(F.lit(0.0), x2 - x1), F.greatest(F.lit(0.0), y2 - y1)
    return {"x1": x1, "y1": y1, "x2": x2, "y2": y2, "width": wide, "height": high, "center_x": (x1 + x2) / 2, "center_y": (y1 + y2) / 2}


def inferred_orientation(b: Box, ratio: float = 2.0) -> Column:
    wide, high = F.greatest(F.lit(0.0), b[2] - b[0]), F.greatest(F.lit(0.0), b[3] - b[1])
    tall = (wide > 0) & (high > 0) & (F.try_divide(high, wide) >= max(1.0, ratio))
    return F.when(tall, "vertical").otherwise("horizontal")


def effective_vertical(orientation: Column, b: Box) -> Column:
    """What is stated, where it is stated, else what the box suggests."""
    from .normalise import strip

    mode = F.translate(F.lower(strip(orientation)), "_", "-")
    return F.when(mode.isin("vertical", "v"), True).when(mode.isin("horizontal", "h"), False).otherwise(inferred_orientation(b) == "vertical")


def pixels(b: Box, wide: int, high: int) -> dict[str, Column]:
    """Corner pixels by rounding half to even, at least one pixel each way, within the page."""
    left = clamp(F.bround(clamp(b[0]) * wide), 0, wide - 1)
    top = clamp(F.bround(clamp(b[1]) * high), 0, high - 1)
    right = clamp(F.bround(clamp(b[2]) * wide), 0, wide)
    bottom = clamp(F.bround(clamp(b[3]) * high), 0, high)
    return {k: c.cast("long") for k, c in {"left": left, "top": top, "right": F.greatest(left + 1, right), "bottom": F.greatest(top + 1, bottom)}.items()}


def connector(a: Box, b: Box) -> dict[str, Column]:
    """Ends of the shortest line between two rectangles: facing edges, or the middle of a common stretch."""
    out = {}
    for axis, lo, hi in (("x", 0, 2), ("y", 1, 3)):
        middle = (F.greatest(a[lo], b[lo]) + F.least(a[hi], b[hi])) / 2
        out[f"from_{axis}"] = F.when(a[hi] < b[lo], a[hi]).when(b[hi] < a[lo], a[lo]).otherwise(middle)
        out[f"to_{axis}"] = F.when(a[hi] < b[lo], b[lo]).when(b[hi] < a[lo], b[hi]).otherwise(middle)
    return out


def heading_level(ratio: Column, baseline: Column) -> Column:
    return F.when(baseline <= 0, 3).when(ratio >= 2.2, 2).when(ratio >= 1.6, 3).otherwise(4)


def list_indent(x1: Column, least: Column) -> Column:
    return (F.greatest(F.lit(0.0), x1 - least) / 0.03).cast("int")


def rects_cross(a: Box, b: Box) -> Column:
    return (a[0] < b[2]) & (a[2] > b[0]) & (a[1] < b[3]) & (a[3] > b[1])


def resized(b: Box, handle: str, dx: float, dy: float, least: float = 0.001) -> dict[str, Column]:
    """A box whose named edges (letters of n, s, w, e) move by dx and dy, kept within the page and of a least size."""
    x1 = F.least(clamp(b[0] + dx), b[2] - least) if "w" in handle else b[0]
    x2 = F.greatest(clamp(b[2] + dx), b[0] + least) if "e" in handle else b[2]
    y1 = F.least(clamp(b[1] + dy), b[3] - least) if "n" in handle else b[1]
    y2 = F.greatest(clamp(b[3] + dy), b[1] + least) if "s" in handle else b[3]
    return {k: F.round(clamp(c), 4) for k, c in {"x1": x1, "y1": y1, "x2": x2, "y2": y2}.items()}
