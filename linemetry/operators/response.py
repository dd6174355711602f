"""Responses: paths, instances and images as nested rows, warnings in order, health."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import wire


#: The contract's version, and a response as it stands in JSON.
CONTRACT = "1.1"
PATH = "point_count int, path_yx array<double>, width_px array<double>, width_mm array<double>, width_at_junction array<boolean>, length_px double, length_mm double, is_loop boolean"
INSTANCE = (
    "instance_id int, label string, score double, bbox_yxyx array<double>, pattern string, orientation_deg double, orientation_class string, tortuosity double, branch_count int, touches_border boolean, "
    "width_samples_excluded int, severity string, width_max_px double, width_mean_px double, width_p95_px double, width_max_mm double, width_mean_mm double, width_p95_mm double, "
    f"length_px double, length_mm double, area_px double, paths struct<items array<struct<{PATH}>>>"
)
RESPONSE = (
    "contract_version string, task string, request_id string, image struct<width int, height int, exif_rotated boolean>, model struct<name string, kind string, trained boolean>, "
    "scale struct<source string, known boolean, mm_per_px double, confidence double, note string>, "
    "summary struct<instance_count int, severity string, max_width_px double, max_width_mm double, total_length_px double, total_length_mm double>, "
    f"instances struct<items array<struct<{INSTANCE}>>>, warnings struct<items array<string>>, duration_ms double"
)
NO_PATHS = f"struct<items array<struct<{PATH}>>>"


def _unless(c: str | Column, kind: str, missing: float = -1.0) -> Column:
    """A number as the response has it; unknown ones are -1, for there is no null in a response."""
    return F.coalesce(wire(F.col(c) if isinstance(c, str) else c, kind), F.lit(missing))


def point_row(i: Column, y: Column, x: Column, width_px: Column, width_mm: Column, at_junction: Column) -> Column:
    """A point as `path_item` takes it, rounded for the wire. A null at_junction counts as away from junctions."""
    return F.struct(i.alias("i"), wire(y, "coordinate").alias("y"), wire(x, "coordinate").alias("x"), _unless(width_px, "width_px").alias("px"), _unless(width_mm, "width_mm").alias("mm"), F.coalesce(at_junction, F.lit(False)).alias("at"))


def path_item(rows: Column, length_px: Column, length_mm: Column, is_loop: Column) -> Column:
    """The item of a path whose points are an array of `point_row` in order."""
    of = lambda f: F.transform(rows, lambda r: r[f])
    return F.struct(
        F.size(rows).alias("point_count"), F.flatten(F.transform(rows, lambda r: F.array(r.y, r.x))).alias("path_yx"), of("px").alias("width_px"), of("mm").alias("width_mm"), of("at").alias("width_at_junction"),
        _unless(length_px, "length_px", 0.0).alias("length_px"), _unless(length_mm, "length_mm").alias("length_mm"), F.coalesce(is_loop, F.lit(False)).alias("is_loop"),
    )


def path_items(points: DataFrame, paths: DataFrame, by: str = "path_id") -> DataFrame:
    """(instance_id, path_id, item) of points (`by`, i, y, x, width_px, width_mm, at_junction) and paths
    (instance_id, path_id, `by`, length_px, length_mm, is_loop): flat arrays in order, rounded for the wire.
    Points without at_junction count as away from junctions."""
    row = point_row(*(F.col(c) for c in ("i", "y", "x", "width_px", "width_mm", "at_junction")))
    p = points.groupBy(by).agg(F.sort_array(F.collect_list(row)).alias("rows")).join(paths, by)
    item = path_item(*(F.col(c) for c in ("rows", "length_px", "length_mm", "is_loop")))
    return p.select("instance_id", "path_id", item.alias("item"))


def instance_item(of: Callable[[str], Column]) -> Column:
    """INSTANCE of what `of` gives for the names in `instance_items`, and for paths: a struct of items."""
    widths = [_unless(of(f"width_{n}_{u}"), f"width_{u}").alias(f"width_{n}_{u}") for u in ("px", "mm") for n in ("max", "mean", "p95")]
    return F.struct(
        of("rank").cast("int").alias("instance_id"), F.lit("crack").alias("label"), _unless(of("score"), "score", 0.0).alias("score"), F.transform(of("bbox_yxyx"), lambda v: wire(v, "coordinate")).alias("bbox_yxyx"), of("pattern").alias("pattern"),
        _unless(of("orientation"), "orientation", 0.0).alias("orientation_deg"), of("orientation_class").alias("orientation_class"), _unless(of("tortuosity"), "tortuosity", 1.0).alias("tortuosity"), of("nodes").cast("int").alias("branch_count"), of("touches_border").alias("touches_border"), of("excluded").cast("int").alias("width_samples_excluded"), of("severity").alias("severity"),
        *widths, _unless(of("length_px"), "length_px", 0.0).alias("length_px"), _unless(of("length_mm"), "length_mm").alias("length_mm"), _unless(of("area_px"), "area", 0.0).alias("area_px"),
        F.coalesce(of("paths"), F.struct(F.array().cast(f"array<struct<{PATH}>>").alias("items"))).alias("paths"),
    )


def instance_items(instances: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(image_id, rank, item) of instances; with `items` of `path_items`, paths in order of path_id, else none.

    instances: (image_id, instance_id, rank, score, bbox_yxyx, pattern, orientation, orientation_class, tortuosity, nodes,
    touches_border, excluded, severity, width_.., length_px, length_mm, area_px). The item is INSTANCE, field by
    field: rank becomes its id, and whatever else instances have stays out."""
    instances = instances.drop("paths")  # their number
    if items is None:
        named = instances.withColumn("paths", F.lit(None).cast(NO_PATHS))
    else:
        grouped = items.groupBy("instance_id").agg(F.struct(F.transform(F.sort_array(F.collect_list(F.struct("path_id", "item"))), lambda p: p["item"]).alias("items")).cast(NO_PATHS).alias("paths"))
        named = instances.join(grouped, "instance_id", "left")
    return named.select("image_id", "rank", instance_item(F.col).alias("item"))


def warnings(images: DataFrame) -> DataFrame:
    """(image_id, warnings) of images (image_id, scale_warnings, factor, blanked, found, reported, at_border, trained, known):
    those of the scale first, then downscaling, the marker, more found than reported, the border, an
    untrained model and an unknown scale, as far as they hold. Images may have `kept`: how many were measured, of
    which not all may have become instances."""
    kept = "kept" if "kept" in images.columns else "reported"
    parts = [
        F.when(F.col("factor") > 1, F.format_string("image reduced by %.2f", "factor")),
        F.when(F.col("blanked"), "the marker was left out"),
        F.when(F.col("found") > F.col(kept), F.format_string("%d found, %d reported", "found", kept)),
        F.when(F.col("at_border") > 0, F.format_string("%d of %d reach the border", "at_border", "reported")),
        F.when(~F.col("trained"), "the model is not trained"),
        F.when(~F.col("known"), "no scale"),
    ]
    return images.select("image_id", F.concat(F.coalesce("scale_warnings", F.array().cast("array<string>")), F.filter(F.array(*parts), lambda w: w.isNotNull())).alias("warnings"))


def responses(images: DataFrame, summaries: DataFrame, items: DataFrame | None, notes: DataFrame, task: str = "crack") -> DataFrame:
    """(image_id, body): the response to each image as JSON of RESPONSE, without nulls; instances in order of rank.

    images: (image_id, request_id, width, height, model_name, model_kind, trained, source, mm_per_px, confidence,
    note, duration_ms). summaries: of `image_summary`; items: of `instance_items`, or None
    if summaries have them in order of rank; notes: of `warnings`."""
    j = images.join(summaries.drop("width", "height"), "image_id")
    if items is not None:
        grouped = items.groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias("items"))
        j = j.join(grouped, "image_id", "left")
    j = j.join(notes, "image_id", "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    body = F.struct(
        F.lit(CONTRACT).alias("contract_version"), F.lit(task).alias("task"), text("request_id").alias("request_id"),
        F.struct(F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.lit(False).alias("exif_rotated")).alias("image"),
        F.struct(text("model_name").alias("name"), text("model_kind").alias("kind"), F.coalesce("trained", F.lit(False)).alias("trained")).alias("model"),
        F.struct(F.coalesce("source", F.lit("none")).alias("source"), F.coalesce(F.col("mm_per_px") > 0, F.lit(False)).alias("known"), _unless("mm_per_px", "scale").alias("mm_per_px"), _unless("confidence", "confidence", 0.0).alias("confidence"), text("note").alias("note")).alias("scale"),
        F.struct(
            F.col("count").cast("int").alias("instance_count"), "severity", _unless("width_max_px", "width_px").alias("max_width_px"), _unless("width_max_mm", "width_mm").alias("max_width_mm"),
            _unless("total_px", "length_px", 0.0).alias("total_length_px"), F.when(F.col("count") == 0, -1.0).otherwise(_unless("total_mm", "length_mm")).alias("total_length_mm"),
        ).alias("summary"),
        F.struct(F.coalesce("items", F.array().cast(f"array<struct<{INSTANCE}>>")).alias("items")).alias("instances"),
        F.struct(F.coalesce("warnings", F.array().cast("array<string>")).alias("items")).alias("warnings"),
        F.coalesce(F.rint(F.col("duration_ms") * 10) / 10, F.lit(-1.0)).alias("duration_ms"),
    )
    return j.select("image_id", F.to_json(body).alias("body"))


def parsed(bodies: DataFrame) -> DataFrame:
    """(image_id, r) of bodies (image_id, body): RESPONSE read back."""
    return read_back(bodies).drop("body")


def read_back(bodies: DataFrame) -> DataFrame:
    """`bodies` (image_id, body) with r, what a reader makes of the body."""
    return bodies.select("image_id", "body", F.from_json("body", RESPONSE).alias("r"))


def registry(tasks: DataFrame, models: DataFrame, fallback: str = "classic-ridge") -> DataFrame:
    """Per task (task, model_name): its model among those that can be loaded (model_name, trained), else the
    fallback, which isn't trained but answers; `others` names the models that are there instead."""
    there = models.agg(F.sort_array(F.collect_set("model_name")).alias("others"))  # one row
    j = tasks.join(models.withColumn("weights_present", F.lit(True)), "model_name", "left").crossJoin(F.broadcast(there))
    present = F.coalesce("weights_present", F.lit(False))
    return j.select("task", F.when(present, F.col("model_name")).otherwise(fallback).alias("model_name"), F.coalesce("trained", F.lit(False)).alias("trained"), present.alias("weights_present"), F.lit(True).alias("ready"), F.when(~present, F.col("others")).alias("others"))


def health(tasks: DataFrame) -> DataFrame:
    """One row of `registry` rows: degraded as soon as one task's model isn't trained."""
    return tasks.agg(F.when(F.bool_or(~F.col("trained")), "degraded").otherwise("ok").alias("status"), F.count("*").alias("tasks"), F.count_if("ready").alias("ready"))
