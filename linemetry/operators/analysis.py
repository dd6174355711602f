"""The whole analysis of images: from probabilities to measured instances, for any number of images.

Rasters go through in blocks (clean, label, distances, values across paths), a component's graph is
made from the mask inside its box, and all else are joins, windows and aggregations. A path has the
key (image_id, comp_id, branch) as a struct, an instance (image_id, comp_id); nothing is packed
into numbers, so paths of different components never meet.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify
from ..sources.shared import kept
from . import blocks as blk
from . import instances as inst
from . import polyline as line
from . import response, width
from .skeleton import graph


@dataclass(frozen=True)
class Options:
    """What an analysis uses if it isn't told otherwise (pixels of the image that is worked on)."""

    min_area: int = 40
    max_instances: int = 200
    min_branch: float = 12.0
    step: float = 3.0
    max_points: int = 2000
    junction_factor: float = 1.5
    junction_floor: float = 2.0
    marker_margin: float = 1.15


BLOCKS = f"{blk.PLACE}, mask array<tinyint>, p array<double>"


def blanked(strips: DataFrame, quads: DataFrame, margin: float = 1.15) -> DataFrame:
    """Strips (image_id, y, x, values) with 0 inside the quadrilateral of their image, widened about its centre.
    quads: (image_id, corners: four structs y, x in order), at most one an image. Edges belong to it."""
    mean = lambda f: F.aggregate("corners", F.lit(0.0), lambda a, c: a + c[f]) / 4
    q = quads.where(F.size("corners") == 4).select("image_id", "corners", mean("y").alias("cy"), mean("x").alias("cx"))
    wide = F.transform("corners", lambda c: F.struct((F.col("cy") + (c.y - F.col("cy")) * margin).alias("y"), (F.col("cx") + (c.x - F.col("cx")) * margin).alias("x")))
    q = q.select("image_id", wide.alias("q"))
    q = q.select("image_id", "q", F.array_min("q.y").alias("low"), F.array_max("q.y").alias("high"))

    def inside(x: Column) -> Column:
        sides = []
        for i in range(4):
            a, b = F.col("q")[i], F.col("q")[(i + 1) % 4]
            sides.append((b.x - a.x) * (F.col("y") - a.y) - (b.y - a.y) * (x - a.x))
        every = lambda f: f(sides[0]) & f(sides[1]) & f(sides[2]) & f(sides[3])
        return every(lambda s: s >= 0) | every(lambda s: s <= 0)

    values = F.when(F.col("y").between(F.col("low"), F.col("high")), F.transform("values", lambda v, i: F.when(inside(F.col("x") + i), 0.0).otherwise(v))).otherwise(F.col("values"))
    return strips.join(q, "image_id", "left").withColumn("values", values).select(*strips.columns)


def cleaned_blocks(strips: DataFrame, images: DataFrame, min_area: int = 40, side: int = blk.SIDE) -> DataFrame:
    """Blocks with the cleaned mask of values at or above the image's threshold, and the values. images: (image_id,
    height, width, threshold)."""
    pieces = blk.strips_to_pieces(strips, images, side, blk.clean_halo(min_area), keep=("threshold",))

    def kernel(w: blk.Window) -> pa.Table:
        p = w.cells["values"]
        return blk.block_table(w, mask=blk.cleaned(w, p >= w.of["threshold"], min_area).astype(np.int8), p=w.inside(p))

    return blk.over_windows(pieces, kernel, BLOCKS, side, blk.clean_halo(min_area), keep=("threshold",))


def block_components(blocks: DataFrame, side: int = blk.SIDE) -> DataFrame:
    """Components of `cleaned_blocks`: (image_id, comp_id, area, box, score)."""
    parts = blk.over_blocks(blocks, lambda w: blk._parts(w, w.cells["mask"].astype(bool), w.cells["p"]), f"{blk.PARTS}, border array<long>", side, ("mask", "p"))
    return blk.merged_components(parts)


GRAPH = "image_id long, comp_id long, nodes long, junctions array<struct<y double, x double>>, branches array<struct<ys array<int>, xs array<int>>>"


def graphs(blocks: DataFrame, components: DataFrame) -> DataFrame:
    """The skeleton of each component, in pixels of the image: how many junctions, their centres, and the branches in
    order. A group holds the mask inside one component's box, and takes the component that comp_id lies in."""
    cut = blocks.select("image_id", "y", "x", "h", "w", "mask").join(components.select("image_id", "comp_id", "y0", "x0", "y1", "x1"), "image_id")
    cut = cut.where((F.col("y") < F.col("y1")) & (F.col("y") + F.col("h") > F.col("y0")) & (F.col("x") < F.col("x1")) & (F.col("x") + F.col("w") > F.col("x0")))
    cut = cut.withColumns({"top": F.greatest("y", "y0"), "left": F.greatest("x", "x0"), "bottom": F.least(F.col("y") + F.col("h"), F.col("y1")), "right": F.least(F.col("x") + F.col("w"), F.col("x1"))})
    rows = F.transform(F.sequence(F.col("top"), F.col("bottom") - 1), lambda r: F.slice("mask", ((r - F.col("y")) * F.col("w") + F.col("left") - F.col("x") + 1).cast("int"), (F.col("right") - F.col("left")).cast("int")))
    cut = cut.withColumn("part", F.flatten(rows))  # by itself: beside an alias w, the w in rows would be that one
    cut = cut.select("image_id", "comp_id", "y0", "x0", "y1", "x1", F.col("top").alias("y"), F.col("left").alias("x"), (F.col("bottom") - F.col("top")).alias("h"), (F.col("right") - F.col("left")).alias("w"), F.col("part").alias("mask"))

    schema = blk.arrow_schema(GRAPH)

    def run(table: pa.Table) -> pa.Table:
        image, comp, y0, x0, y1, x1 = (table.column(c)[0].as_py() for c in ("image_id", "comp_id", "y0", "x0", "y1", "x1"))
        mask = blk.pasted(table, "mask", y0, x0, (y1 - y0, x1 - x0)).astype(bool)
        of = blk.labelled(mask).grid(mask.shape)
        branches, centres, nodes = graph(of == of[comp // blk.STRIDE - y0, comp % blk.STRIDE - x0])
        row = {
            "image_id": image, "comp_id": comp, "nodes": nodes, "junctions": [{"y": y + y0, "x": x + x0} for y, x in centres.tolist()],
            "branches": [{"ys": (p[:, 0] + y0).tolist(), "xs": (p[:, 1] + x0).tolist()} for p in branches],
        }
        return pa.Table.from_pylist([row], schema=schema)

    return cut.groupBy("image_id", "comp_id").applyInArrow(run, GRAPH)


def branch_points(graphs: DataFrame, min_length: float) -> DataFrame:
    """(path_id, i, y, x) of the branches that are long enough; path_id is a struct of image_id, comp_id and branch."""
    step = F.transform(F.sequence(F.lit(1), F.size("ys") - 1), lambda i: F.hypot(F.element_at("ys", i + 1) - F.element_at("ys", i), F.element_at("xs", i + 1) - F.element_at("xs", i)))
    flat = graphs.select("image_id", "comp_id", F.posexplode("branches").alias("branch", "b")).select("image_id", "comp_id", "branch", "b.ys", "b.xs")
    flat = flat.where(F.size("ys") > 1).where(F.aggregate(step, F.lit(0.0), lambda a, v: a + v) >= min_length)
    points = flat.select(F.struct("image_id", "comp_id", "branch").alias("path_id"), F.posexplode(F.arrays_zip("ys", "xs")).alias("i", "q"))
    return points.select("path_id", F.col("i").cast("long").alias("i"), F.col("q.ys").cast("double").alias("y"), F.col("q.xs").cast("double").alias("x"))


def measured_points(strips: DataFrame, images: DataFrame, blocks: DataFrame, components: DataFrame, graphs: DataFrame, options: Options, side: int = blk.SIDE, uniform: bool = True) -> DataFrame:
    """(image_id, comp_id, branch, path_id, i, y, x, width_px, at_junction) of the sample points, in pixels of the image that
    is worked on. images: (image_id, height, width, threshold, method). uniform: points at equal steps, at
    most max_points a path; else those that simplification leaves."""
    raw = branch_points(graphs, options.min_branch)
    if uniform:
        points = line.resample_cap(line.resample_uniform(raw, options.step).withColumnRenamed("j", "i"), options.max_points)
    else:
        points = line.simplify_rdp(raw, 1.0)
    points = points.select("path_id", "i", "y", "x", "path_id.image_id", "path_id.comp_id", "path_id.branch")
    points = points.join(components.select("image_id", "comp_id", "y0", "x0", "y1", "x1"), ["image_id", "comp_id"]).join(images.select("image_id", "threshold", "method"), "image_id")
    points = kept(points)
    edges = blk.with_halo(width.distances(blocks.withColumn("values", F.col("mask")), side), side, 1)
    coarse = width.widths_from_distance(points, edges, images, side).withColumnRenamed("width_px", "coarse")
    pieces = blk.strips_to_pieces(strips, images, side, width.REACH)
    wide = width.widths_perpendicular(coarse, pieces, images, side)
    wide = wide.withColumn("width_px", F.when(F.col("method") == "distance_transform", F.col("coarse")).otherwise(F.col("width_px")))
    near = F.array_min(F.transform("junctions", lambda j: F.hypot(F.col("y") - j.y, F.col("x") - j.x)))
    at = F.coalesce(near <= F.greatest(F.col("width_px") * options.junction_factor, F.lit(options.junction_floor)), F.lit(False))
    joined = wide.join(graphs.select("image_id", "comp_id", "junctions"), ["image_id", "comp_id"])
    return joined.select("image_id", "comp_id", "branch", "path_id", "i", "y", "x", "width_px", at.alias("at_junction"))


@dataclass
class Analysis:
    """points, paths and instances in pixels of the original image; summaries and notes, a row for each image."""

    points: DataFrame
    paths: DataFrame
    instances: DataFrame
    summaries: DataFrame
    notes: DataFrame


def analyse(strips: DataFrame, images: DataFrame, scales: DataFrame, options: Options = Options(), side: int = blk.SIDE) -> Analysis:
    """Measure every image.

    strips: (image_id, y, x, values), probabilities by runs of a row. images: (image_id, height, width: of the
    strips; factor: to the original's pixels; threshold, method, trained). scales: at most one row an
    image (image_id, mm_per_px, h: projective map or null, corners: of a marker in the original's
    pixels or null, warnings). In turn: the marker is blanked, the mask cleaned, components found and the
    largest kept, their skeletons walked, branches resampled, widths measured across them, places
    near junctions marked, all brought to the original's pixels and to mm, and summed up. Images
    without strips or components have a summary with no instances. A component without a branch of
    min_branch pixels isn't an instance. Blocks, components, skeletons, points and instances are written to the shared
    folder as they are made. Unknown lengths and widths in mm are -1. Rows with null image_id
    are left out; other columns are ignored.
    """
    scaled = images.join(scales, "image_id", "left")
    quads = scaled.where("corners is not null").select("image_id", F.transform("corners", lambda c: F.struct((c.y / F.col("factor")).alias("y"), (c.x / F.col("factor")).alias("x"))).alias("corners"))
    strips = blanked(strips.select("image_id", "y", "x", "values"), quads, options.marker_margin)
    blocks = kept(cleaned_blocks(strips, images, options.min_area, side))
    every = kept(block_components(blocks, side).where(F.col("area") >= options.min_area))
    components = inst.largest(every, options.min_area, options.max_instances)
    found = kept(graphs(blocks, components))
    points = kept(measured_points(strips, images, blocks, components, found, options, side))

    local = points.join(scaled.select("image_id", "factor", "mm_per_px", "h"), "image_id")
    local = local.withColumns({c: F.col(c) * F.col("factor") for c in ("y", "x", "width_px")})
    local = local.withColumn("mm_per_px", classify.local_scale(F.col("mm_per_px"), F.col("h"), F.col("x"), F.col("y")))
    local = local.withColumn("width_mm", F.coalesce(classify.to_mm(F.col("width_px"), F.col("mm_per_px")), F.lit(-1.0)))
    local = local.withColumn("instance_id", F.struct("image_id", "comp_id")).drop("h", "factor")

    shapes = line.shapes(local.select("path_id", "i", "y", "x")).join(line.length_mm(local.select("path_id", "i", "y", "x", "mm_per_px"), "mm_per_px"), "path_id")
    paths = shapes.select(F.struct("path_id.image_id", "path_id.comp_id").alias("instance_id"), F.col("path_id").alias("path"), F.col("path_id.branch").alias("path_id"), "length", F.coalesce("length_mm", F.lit(-1.0)).alias("length_mm"), "orientation", "tortuosity", "is_loop")

    totals = inst.instance_totals(paths).join(inst.width_summary(local), "instance_id")
    of = components.join(found.select("image_id", "comp_id", "nodes"), ["image_id", "comp_id"]).join(images.select("image_id", "height", "width", "factor"), "image_id")
    factor = F.col("factor")
    box_area = F.greatest((F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0")), F.lit(1)) * factor * factor
    of = of.select(
        F.struct("image_id", "comp_id").alias("instance_id"), "image_id", "comp_id", "score", "nodes", (F.col("area") * factor * factor).alias("area_px"),
        F.array(*[F.col(c) * factor for c in ("y0", "x0", "y1", "x1")]).alias("bbox_yxyx"), box_area.alias("box_area"),
        classify.touches_border(F.col("y0"), F.col("x0"), F.col("y1"), F.col("x1"), F.col("height"), F.col("width")).alias("touches_border"),
    )
    instances = totals.join(of, "instance_id").withColumns({
        "pattern": classify.pattern(F.col("nodes"), F.col("length_px"), F.col("box_area")),
        "orientation_class": classify.orientation_class(F.col("orientation")),
    }).drop("box_area")
    instances = kept(inst.ranked(instances, "image_id"))

    summaries = inst.image_summary(images, instances)
    overflow = every.groupBy("image_id").agg(F.count("*").alias("found"))
    told = scaled.join(overflow, "image_id", "left").join(summaries.select("image_id", "count", "at_border"), "image_id")
    told = told.select("image_id", F.col("warnings").alias("scale_warnings"), "factor", F.col("corners").isNotNull().alias("blanked"), F.coalesce("found", F.lit(0)).alias("found"), F.least(F.coalesce("found", F.lit(0)), F.lit(options.max_instances)).alias("kept"), F.col("count").alias("reported"), "at_border", "trained", F.coalesce(F.col("mm_per_px") > 0, F.lit(False)).alias("known"))
    return Analysis(local, paths, instances, summaries, response.warnings(told))


def measure(strips: DataFrame, images: DataFrame, options: Options = Options(), side: int = blk.SIDE) -> DataFrame:
    """Per image (image_id, height, width, threshold) with an instance: greatest, mean and 95th percentile of all widths,
    total length and instances, as accuracy is measured: branches are simplified, and places near
    junctions count."""
    images = images.withColumn("method", F.lit("perpendicular"))
    blocks = kept(cleaned_blocks(strips, images, options.min_area, side))
    components = kept(block_components(blocks, side).where(F.col("area") >= options.min_area))
    points = kept(measured_points(strips, images, blocks, components, kept(graphs(blocks, components)), options, side, uniform=False))
    lengths = line.shapes(points.select("path_id", "i", "y", "x")).select("path_id.image_id", "length")
    of = points.select("image_id", "comp_id").distinct()
    return inst.measured(points, lengths, of)
