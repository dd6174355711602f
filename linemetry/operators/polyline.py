"""Operators on ordered points (path_id, i, y, x) by window functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_path():
    return Window.partitionBy("path_id").orderBy("i")


def segments(points: DataFrame) -> DataFrame:
    """Adds seg (length of the step to this point) and s (length so far)."""
    step = F.hypot(F.col("x") - F.lag("x").over(by_path()), F.col("y") - F.lag("y").over(by_path()))
    return points.withColumn("seg", F.coalesce(step, F.lit(0.0))).withColumn("s", F.sum("seg").over(by_path()))


def shapes(points: DataFrame) -> DataFrame:
    """Length, tortuosity, main direction (degrees, [-90, 90)) and whether the path is closed."""
    ends = lambda f, c: f(c, "i")
    n = segments(points).groupBy("path_id").agg(
        F.count("*").alias("point_count"), F.sum("seg").alias("length"),
        ends(F.min_by, "x").alias("xa"), ends(F.min_by, "y").alias("ya"), ends(F.max_by, "x").alias("xb"), ends(F.max_by, "y").alias("yb"),
        F.covar_samp("x", "y").alias("c"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"),
    )
    chord = F.hypot(F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya"))
    angle = F.when(F.col("point_count") < 2, 0.0).otherwise(-0.5 * F.degrees(F.atan2(2 * F.col("c"), F.col("vx") - F.col("vy"))))
    return n.select("path_id", "point_count", "length", F.when((chord < 1e-6) | (F.col("point_count") < 2), 1.0).otherwise(F.greatest(F.lit(1.0), F.try_divide("length", chord))).alias("tortuosity"), F.when(angle >= 90, angle - 180).otherwise(angle).alias("orientation"), (chord < 1e-6).alias("is_loop"))


def resample_uniform(points: DataFrame, step: float) -> DataFrame:
    """(path_id, j, x, y): points at equal distances near `step` along the path, ends kept, by linear interpolation.
    Single points, and all if step isn't positive, stay as they are; a path without length has its ends twice."""
    if step <= 0:
        return points.select("path_id", F.col("i").cast("long").alias("j"), "x", "y")
    s = segments(points).withColumns({"s0": F.coalesce(F.lag("s").over(by_path()), F.lit(0.0)), "x0": F.lag("x").over(by_path()), "y0": F.lag("y").over(by_path())})
    total = F.max("s").over(Window.partitionBy("path_id"))
    s = s.withColumn("total", total).withColumn("n", F.greatest(F.lit(2), F.rint(F.col("total") / step) + 1).cast("int"))
    # targets j with s0 < j * total / (n - 1) <= s; the first point has target 0
    unit = F.col("total") / (F.col("n") - 1)
    a, b = F.floor(F.try_divide("s0", unit) + 1e-9) + 1, F.floor(F.try_divide("s", unit) + 1e-9)
    first = s.where("i = 0").select("path_id", F.lit(0).cast("long").alias("j"), "x", "y")
    inner = s.where((F.col("i") > 0) & (F.col("total") > 0)).where(a <= b).withColumn("j", F.explode(F.sequence(a, b))).withColumn("f", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("j") * unit - F.col("s0")) / F.col("seg"))))
    lerp = lambda c: F.col(f"{c}0") + (F.col(c) - F.col(f"{c}0")) * F.col("f")
    still = s.where("i = 1 and total = 0").select("path_id", F.lit(1).cast("long").alias("j"), "x", "y")
    return first.union(inner.select("path_id", "j", lerp("x"), lerp("y"))).union(still)


def tangents(points: DataFrame) -> DataFrame:
    """Unit vectors (ty, tx) from k points before to k points after, clipped at the ends; k is 2, on
    paths of two or three points 1. Where these two meet, from one before to one after. A single
    point has (0, 1); where all meet it is (0, 0)."""
    whole = Window.partitionBy("path_id")
    ordered = whole.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.count("*").over(whole)

    def span(c: str, k: int) -> Column:
        return F.coalesce(F.lead(c, k).over(by_path()), F.last(c).over(ordered)) - F.coalesce(F.lag(c, k).over(by_path()), F.first(c).over(ordered))

    p = points.select("path_id", "i", n.alias("n"), *[span(c, k).alias(f"{c}{k}") for c in ("y", "x") for k in (1, 2)])
    wide = (F.col("n") >= 4) & (F.hypot("y2", "x2") >= 1e-9)
    p = p.select("path_id", "i", "n", *[F.when(wide, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(c) for c in ("y", "x")])
    norm = F.hypot("y", "x")
    norm = F.when(norm < 1e-9, 1.0).otherwise(norm)
    return p.select("path_id", "i", F.when(F.col("n") == 1, 0.0).otherwise(F.col("y") / norm).alias("ty"), F.when(F.col("n") == 1, 1.0).otherwise(F.col("x") / norm).alias("tx"))


def resample_cap(points: DataFrame, most: int) -> DataFrame:
    """At most `most` points of each path: those nearest (half to even) to equal steps of i, which
    counts from 0; the ends stay."""
    n = F.count("*").over(Window.partitionBy("path_id"))
    kept = F.transform(F.sequence(F.lit(0), F.lit(max(0, most - 1))), lambda k: F.rint(k * (F.col("n") - 1) / F.lit(max(1, most - 1))).cast("long"))
    return points.withColumn("n", n).where((F.col("n") <= most) | F.array_contains(kept, F.col("i").cast("long"))).drop("n")


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of one path the Ramer-Douglas-Peucker rule keeps: a point stays if it is the
    farthest (the first of equals) from the chord of its stretch, and farther than the tolerance."""
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    stretches = [(0, len(points) - 1)]
    while stretches:
        a, b = stretches.pop()
        if b - a < 2:
            continue
        chord, rel = points[b] - points[a], points[a + 1 : b] - points[a]
        length = np.hypot(*chord)
        off = np.abs(chord[1] * rel[:, 0] - chord[0] * rel[:, 1]) / length if length > 1e-12 else np.hypot(rel[:, 0], rel[:, 1])
        m = int(off.argmax())
        if off[m] > tolerance:
            keep[a + 1 + m] = True
            stretches += [(a, a + 1 + m), (a + 1 + m, b)]
    return keep


def simplify_rdp(points: DataFrame, tolerance: float) -> DataFrame:
    """`points` that Ramer-Douglas-Peucker keeps, one path a group; paths of up to two points stay."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("i", "ascending")])
        flat = np.stack([table.column(c).to_numpy().astype(float) for c in ("y", "x")], axis=1)
        return table.filter(pa.array(simplified(flat, tolerance)))

    return points.groupBy("path_id").applyInArrow(run, points.schema)


def to_original(points: DataFrame, factor: str = "factor") -> DataFrame:
    """Points of a crop (at y0, x0) of a downscaled image, in pixels of the original one; widths too."""
    moved = {c: (F.col(c) + F.col(f"{c}0")) * F.col(factor) for c in ("y", "x")}
    return points.withColumns(moved | ({"width_px": F.col("width_px") * F.col(factor)} if "width_px" in points.columns else {}))


def length_mm(points: DataFrame, scale: str) -> DataFrame:
    """Sum of steps times the mean scale of their ends; null if a scale is unknown."""
    before = F.lag(scale).over(by_path())
    s = segments(points).withColumn("mm", F.col("seg") * (F.col(scale) + before) / 2)
    return s.groupBy("path_id").agg(F.when(F.bool_or(F.col(scale) <= 0) | (F.count("*") < 2), None).otherwise(F.sum("mm")).alias("length_mm"))


def junction_mask(points: DataFrame, junctions: DataFrame, factor: float = 1.5, floor: float = 2.0) -> DataFrame:
    """at_junction: the nearest junction (path_id, jx, jy) is within max(width * factor, floor)."""
    near = points.join(junctions, "path_id", "left").groupBy("path_id", "i", "width").agg(F.min(F.hypot(F.col("x") - F.col("jx"), F.col("y") - F.col("jy"))).alias("d"))
    return near.select("path_id", "i", F.coalesce(F.col("d") <= F.greatest(F.col("width") * factor, F.lit(floor)), F.lit(False)).alias("at_junction"))
