"""Scalar classification and scale functions as Column expressions.

Unknown numbers are null inside the library; -1 stands for them only at the contract's border.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper limits (exclusive, mm) of the severity classes.
SEVERITY = ((0.10, "hairline"), (0.20, "fine"), (0.30, "moderate"), (0.50, "wide"))


def severity(mm: Column) -> Column:
    out = F.when(mm.isNull() | (mm < 0), "unknown")
    for upper, name in SEVERITY:
        out = out.when(mm < upper, name)
    return out.otherwise("severe")


def orientation_class(degrees: Column) -> Column:
    a = F.abs(F.pmod(degrees + 90, F.lit(180.0)) - 90)
    return F.when(a <= 22.5, "horizontal").when(a >= 67.5, "vertical").otherwise("diagonal")


def pattern(nodes: Column, length: Column, bbox_area: Column) -> Column:
    density, fill = nodes / F.greatest(length, F.lit(1.0)), length / F.greatest(bbox_area, F.lit(1.0))
    return F.when(length <= 0, "unknown").when((nodes >= 6) & (density >= 0.004) & (fill >= 0.06), "map").when(nodes >= 1, "branched").otherwise("linear")


def sigmoid(x: Column) -> Column:
    """Never overflows: the exponent is never positive."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def to_mm(width_px: Column, mm_per_px: Column) -> Column:
    return F.when(mm_per_px > 0, width_px * mm_per_px)


def lidar_scale(depth_mm: Column, focal_px: Column, tilt: Column) -> tuple[Column, Column]:
    """(mm per px, confidence); tilt null or below 0: unknown, taken as frontal; 75 degrees and more: no scale."""
    known = F.coalesce(tilt >= 0, F.lit(False))
    usable = (depth_mm > 0) & (focal_px > 0) & (~known | (tilt < 75))
    base = depth_mm / focal_px
    tilted = base / F.greatest(F.cos(F.radians(tilt)), F.lit(1e-3))
    return F.when(usable, F.when(known, tilted).otherwise(base)), F.when(usable, F.when(~known, 0.6).when(tilt >= 45, 0.4).otherwise(0.7))


def homography_scale(h: list[Column], x: Column, y: Column) -> Column:
    """Root of the Jacobian's determinant of a 3x3 homography (9 columns, by rows) at (x, y)."""
    w = h[6] * x + h[7] * y + h[8]
    w = F.when(F.abs(w) < 1e-12, 1e-12).otherwise(w)
    u, v = (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w
    a, b, c, d = (h[0] - u * h[6]) / w, (h[1] - u * h[7]) / w, (h[3] - v * h[6]) / w, (h[4] - v * h[7]) / w
    return F.sqrt(F.greatest(F.abs(a * d - b * c), F.lit(1e-18)))


def local_scale(mm_per_px: Column, h: Column, x: Column, y: Column) -> Column:
    """mm per px at (x, y): -1 if unknown, one for all without a projective map h (array of nine), else of that."""
    return F.when(~F.coalesce(mm_per_px > 0, F.lit(False)), -1.0).when(h.isNull(), mm_per_px).otherwise(homography_scale([h[i] for i in range(9)], x, y))


def touches_border(y0: Column, x0: Column, y1: Column, x1: Column, height: int, width: int) -> Column:
    """Whether a half-open box reaches the border of its image."""
    return (y0 == 0) | (x0 == 0) | (y1 >= height) | (x1 >= width)


def given(value: Column) -> Column:
    """A number of a request: null and negative mean that it isn't given; 0 is given."""
    return F.when(value >= 0, value)


def threshold_of(asked: Column, model: Column, default: float = 0.5) -> Column:
    """The caller's threshold if given, else the model's if positive, else the default."""
    return F.coalesce(given(asked), F.when(model > 0, model), F.lit(default))


#: Ways to measure a width that a request may name.
METHODS = ("perpendicular", "distance_transform")


def known_method(name: Column) -> Column:
    """Whether a request's method can be had; none named is fine."""
    return F.coalesce(name, F.lit("")).isin("", *METHODS)


#: Decimals on the wire.
DECIMALS = {"coordinate": 2, "width_px": 3, "width_mm": 4, "score": 4, "length_px": 2, "length_mm": 3, "area": 1, "scale": 6, "confidence": 3, "orientation": 2, "tortuosity": 4}


def wire(value: Column, kind: str) -> Column:
    """A number as the response has it: scaled to the decimals of its kind, half to even."""
    scale = float(10 ** DECIMALS[kind])
    return F.rint(value.cast("double") * scale) / scale


def whole(total: Column) -> Column:
    """A sum to whole numbers, half to even. Sums of decimals are off by their last bits, as the order of adding has it,
    so what is within half a millionth of a tie is the tie."""
    return F.rint(F.round(total, 6))
