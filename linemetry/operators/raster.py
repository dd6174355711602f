"""Raster operators on (image_id, y, x, p) rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import thinned

KEY = ("image_id", "y", "x")


def threshold_mask(pixels: DataFrame, threshold: float = 0.5) -> DataFrame:
    return pixels.where(F.col("p") >= threshold)


def shifted(pixels: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """A row for each pixel and offset (dy, dx), moved by it: the equi-join form of a stencil."""
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in offsets])).alias("o")
    return pixels.select("*", moves).withColumns({"y": F.col("y") + F.col("o.dy"), "x": F.col("x") + F.col("o.dx")}).drop("o")


RING = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
def neighbour_count(mask: DataFrame) -> DataFrame:
    """Set pixels among the 8 neighbours of each set pixel."""
    near = shifted(mask.select(*KEY), RING).groupBy(*KEY).agg(F.count("*").alias("neighbours"))
    return mask.select(*KEY).join(near, list(KEY), "left").select(*KEY, F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


#: Steps to half of a pixel's neighbours, for 8- and 4-connected components.
HALF = {8: ((0, 1), (1, -1), (1, 0), (1, 1)), 4: ((0, 1), (1, 0))}


def label_components(mask: DataFrame, connected: int = 8) -> DataFrame:
    """Adds comp_id: the smallest y * 65536 + x of the pixel's 8- or 4-connected component. An image
    is one group (its size is bounded by the image source); images are spread over tasks."""

    def label(table: pa.Table) -> pa.Table:
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        key = y * 65536 + x
        order = np.argsort(key)
        root = key[order].copy()
        sorted_key = key[order]
        links = []
        for dy, dx in HALF[connected]:
            other = sorted_key + dy * 65536 + dx
            at = np.minimum(np.searchsorted(sorted_key, other), len(key) - 1)
            hit = sorted_key[at] == other
            links.append((np.flatnonzero(hit), at[hit]))
        a, b = (np.concatenate(z) for z in zip(*links, strict=True))
        while True:  # smallest label over links, until nothing changes
            least = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, a, least)
            np.minimum.at(root, b, least)
            root = root[np.searchsorted(sorted_key, root)]  # pointer jump: a label is a pixel's key
            if (root == before).all():
                break
        comp = np.empty_like(root)
        comp[order] = root
        return table.append_column("comp_id", pa.array(comp))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in mask.schema.fields)
    return mask.groupBy("image_id").applyInArrow(label, f"{schema}, comp_id long")


def tile_starts(place: Column, length: int, tile: int, overlap: int) -> Column:
    """The starts of the tiles that cover a place on an axis. Tiles follow each other by tile -
    overlap as long as they fit; if they don't reach the end, one more is set there."""
    step, last = max(1, tile - overlap), max(0, length - tile)
    fit = last // step  # number of the last one that fits
    low = F.greatest(F.lit(0), F.ceil((place - (tile - 1)) / step)).cast("long")
    high = F.least(F.lit(fit), F.floor(place / step)).cast("long")
    regular = F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda k: k * step)).otherwise(F.array().cast("array<long>"))
    if last == fit * step:
        return regular
    return F.when(place >= last, F.concat(regular, F.array(F.lit(last).cast("long")))).otherwise(regular)


def tile_blend(pixels: DataFrame, tile: int, overlap: int, height: int, width: int) -> DataFrame:
    """Overlapping tiles with raised-cosine weights, blended back: sum(p w) / sum(w). A pixel meets
    only the tiles that cover it."""
    covered = pixels.withColumn("ty", F.explode(tile_starts(F.col("y"), height, tile, overlap))).withColumn("tx", F.explode(tile_starts(F.col("x"), width, tile, overlap)))
    bell = lambda c: 0.5 - 0.5 * F.cos(2 * np.pi * (c + 1) / (tile + 1))
    weight = F.greatest(F.lit(1e-3), bell(F.col("y") - F.col("ty")) * bell(F.col("x") - F.col("tx")))
    return covered.withColumn("w", weight).groupBy(*KEY).agg((F.sum(F.col("p") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-6))).alias("p"), F.count("*").alias("tiles"))


def blank_quad(pixels: DataFrame, quads: DataFrame, margin: float = 1.15) -> DataFrame:
    """`pixels` with p 0 inside the quadrilateral of their image, widened about its centre. quads:
    (image_id, corners: four structs y, x in order), at most one an image. Edges belong to it."""
    wide = F.transform("corners", lambda c: F.struct((F.col("cy") + (c.y - F.col("cy")) * margin).alias("y"), (F.col("cx") + (c.x - F.col("cx")) * margin).alias("x")))
    mean = lambda f: F.aggregate("corners", F.lit(0.0), lambda a, c: a + c[f]) / 4
    quads = quads.select("image_id", "corners", mean("y").alias("cy"), mean("x").alias("cx")).select("image_id", wide.alias("q"))
    sides = []
    for i in range(4):
        a, b = F.col("q")[i], F.col("q")[(i + 1) % 4]
        sides.append((b.x - a.x) * (F.col("y") - a.y) - (b.y - a.y) * (F.col("x") - a.x))
    inside = (sides[0] >= 0) & (sides[1] >= 0) & (sides[2] >= 0) & (sides[3] >= 0) | (sides[0] <= 0) & (sides[1] <= 0) & (sides[2] <= 0) & (sides[3] <= 0)
    joined = pixels.join(quads, "image_id", "left")
    return joined.withColumn("p", F.when(inside, 0.0).otherwise(F.col("p"))).select(*pixels.columns)


def ridge_normalise(pixels: DataFrame) -> DataFrame:
    """A filter's answers p as probabilities: from the 60th to the 99.5th percentile of each image to
    0..1; 0 where the greatest or the range is below 1e-9."""
    of = pixels.groupBy("image_id").agg(F.percentile("p", F.lit(0.6)).alias("low"), F.percentile("p", F.lit(0.995)).alias("high"), F.max("p").alias("most"))
    j = pixels.join(of, "image_id")
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(F.col("p") - F.col("low"), F.col("high") - F.col("low"))))
    return j.withColumn("p", F.when((F.col("most") <= 1e-9) | (F.col("high") - F.col("low") < 1e-9), 0.0).otherwise(part)).select(*pixels.columns)


def downscale(pixels: DataFrame, factor: int) -> DataFrame:
    """Means of squares of `factor` pixels a side."""
    return pixels.groupBy("image_id", F.floor(F.col("y") / factor).alias("y"), F.floor(F.col("x") / factor).alias("x")).agg(F.avg("p").alias("p"))


def confusion(pixels: DataFrame, truth: float, thresholds: tuple[float, ...]) -> DataFrame:
    """tp, fp, fn and iou, f1 at each threshold against the mask p >= truth."""
    grid = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    hit, real = F.col("p") >= F.col("threshold"), F.col("p") >= truth
    n = pixels.select("*", grid).groupBy("threshold").agg(F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.withColumn("iou", tp / (tp + fp + fn + 1e-7)).withColumn("f1", 2 * tp / (2 * tp + fp + fn + 1e-7))


def skeletonise(mask: DataFrame) -> DataFrame:
    """Thinning to centre lines (Zhang and Suen 1984), one image a group."""
    def thin(table: pa.Table) -> pa.Table:
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        grid = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), dtype=bool)
        grid[y - y.min(), x - x.min()] = True
        return table.filter(pa.array(thinned(grid)[y - y.min(), x - x.min()]))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in mask.schema.fields)
    return mask.groupBy("image_id").applyInArrow(thin, schema)


def area_and_length(mask: DataFrame) -> DataFrame:
    """Per image: set pixels (area) and pixels of the skeleton (length)."""
    areas = mask.groupBy("image_id").agg(F.count("*").alias("area"))
    return areas.join(skeletonise(mask).groupBy("image_id").agg(F.count("*").alias("length")), "image_id", "left").fillna(0, ["length"])


def annotation_widths(mask: DataFrame, min_area: int = 40, min_length: int = 5) -> DataFrame:
    """Per image: mean width area / length; 0 below `min_area` pixels (no line), 999 where the
    skeleton is too short to tell."""
    width = F.when(F.col("area") < min_area, 0.0).when(F.col("length") < min_length, 999.0).otherwise(F.col("area") / F.col("length"))
    return area_and_length(mask).withColumn("width_px", width)


def width_bias(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Per image of either mask: area per skeleton pixel of `pred` over that of `truth`; NaN where
    one of them is empty."""
    each = [area_and_length(m).where("length > 0").select("image_id", (F.col("area") / F.col("length")).alias(c)) for m, c in ((pred, "pred_px"), (truth, "truth_px"))]
    return each[0].join(each[1], "image_id", "full").select("image_id", F.coalesce(F.col("pred_px") / F.col("truth_px"), F.lit(float("nan"))).alias("width_bias"))
